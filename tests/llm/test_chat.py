import hashlib
import random

from bindery.llm.chat import chat_digest, format_chats, parse_turns

from .cases import CLASHING, frame

PARTS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "[SYS]", "<", "[", "\\", "/", "s>", "ROLE]",
         "a", "\n", "é", "<\\s>", "[\\\\/ROLE]", "$1"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort(key=lambda t: t[:2])
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def test_any_text_comes_back(spark):
    rng = random.Random(3)

    def text():
        return "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))

    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(300) for t in range(3)]
    rows += [(1000, 0, None, None), (1000, None, "user", "first"), (1001, 0, "assistant", "</s>" * 3000)]
    rows += [(None, 0, "user", "no conversation")]
    df = frame(spark, rows, SCHEMA)
    for name in CLASHING.split():
        df = df.withColumn(name, df["role"])
    formatted = format_chats(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat_digest(formatted).collect()}
    assert got == expected(rows)
    turns = formatted.select(parse_turns(formatted["formatted"]).alias("t")).collect()
    assert all(t["sound"] for r in turns for t in r["t"])


def test_mask_covers_assistant_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a </s> b"), (1, 2, "assistant", "")]
    r = format_chats(frame(spark, rows, SCHEMA)).head()
    at, lossy, out = 0, False, []
    for n in r["mask_runs"]:
        if lossy:
            out.append(r["formatted"][at:at + n])
        at, lossy = at + n, not lossy
    assert at == len(r["formatted"])
    assert [o for o in out if o] == ["a <\\/s> b"]


def test_repeated_rows_stay_and_plain_text_is_not_escaped(spark):
    rows = [(1, 0, "user", "hi")] * 2
    r = format_chats(frame(spark, rows, SCHEMA)).head()
    assert r["formatted"] == "<s>[ROLE]user[/ROLE]hi</s>" * 2 and r["n_escaped"] == 0


def test_no_rows(spark):
    assert chat_digest(format_chats(frame(spark, [], SCHEMA))).collect() == []
