import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bindery.llm.bpe import decode_documents, encode_documents, round_trip_digest
from bindery.llm.token_counts import count_documents, prefix_counts
from bindery.llm.training_order import Feistel, read_sequences, sequence_at, write_shards

from .cases import frame, no_documents, odd_documents, odd_rows, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(WORDS)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def mixed_texts():
    rng = random.Random(5)
    parts = ["the", "Hello", " ", "  ", "\n", "\t", "é", "▁", "\x01", "\x02", "ing", "Éle", "日本", "😀", "12", ".,", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows():
    return [(i, r[1]) for i, r in enumerate(odd_rows())] + [(1000 + i, t) for i, t in enumerate(mixed_texts())]


def test_round_trip_is_the_library(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in round_trip_digest(frame(spark, rows), WORDS).collect()}
    for doc_id, text in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        back = TOKENIZER.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
        ), text


def test_ids_and_the_piece_join(spark, rows):
    encoded = encode_documents(frame(spark, rows), WORDS)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(ids[d] == TOKENIZER.encode(t or "", add_special_tokens=False).ids for d, t in rows)
    back = {r["doc_id"]: r["decoded"] for r in decode_documents(encoded, WORDS).collect()}
    assert all(back[d] == TOKENIZER.decode(ids[d], skip_special_tokens=False) for d, _ in rows)


def test_counts_are_the_library(spark, rows):
    got = {r["doc_id"]: r for r in count_documents(frame(spark, rows), PIECES, limit=5).collect()}
    for doc_id, text in rows:
        text, r = text or "", got[doc_id]
        n = len(MODEL.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 5), text
        fits = [k for k in range(len(text) + 1) if len(MODEL.encode(text[:k])) <= 5] if len(text) < 60 else []
        assert not fits or r["kept_chars"] == fits[-1], text


def test_every_prefix_is_counted(spark, rows):
    short = [(d, t) for d, t in rows if len(t or "") < 60]
    got = {r["doc_id"]: r["n_tokens_at"] for r in prefix_counts(frame(spark, short), PIECES).collect()}
    for doc_id, text in short:
        assert got[doc_id] == [len(MODEL.encode((text or "")[:k])) for k in range(len(text or "") + 1)], text


def test_a_text_without_spaces_is_counted(spark):
    text = "".join(random.Random(1).choice("abcdefghij") for _ in range(20_000))
    row = count_documents(frame(spark, [(1, text)]), PIECES, limit=4096).head()
    assert row["n_tokens"] == len(MODEL.encode(text)) and len(MODEL.encode(text[:row["kept_chars"]])) <= 4096


def test_odd_tables(spark, tmp_path):
    n = len(odd_rows())
    odd, none = odd_documents(spark), no_documents(spark)
    for f in (lambda d: round_trip_digest(d, WORDS), lambda d: encode_documents(d, WORDS),
              lambda d: count_documents(d, PIECES, 10), lambda d: prefix_counts(d, PIECES)):
        assert f(odd).count() == n and f(none).collect() == []
    assert write_shards(none, str(tmp_path / "none"), PIECES) == 0
    assert read_sequences(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_feistel_is_a_permutation(n):
    slots = Feistel(n, 9).slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert Feistel(n, 9).numbers(slots).tolist() == list(range(n))
    if n > 200:
        assert (Feistel(n, 9).slots(np.arange(n)) != Feistel(n, 10).slots(np.arange(n))).any()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    rows = [(i, prose(i, 10 + 7 * i)) for i in range(40)] + [(3, "again"), (None, None)]
    total = write_shards(frame(spark, rows), str(tmp_path / "s"), PIECES, key=4, sequence=16, shard_rows=32)
    got = read_sequences(spark, str(tmp_path / "s")).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(total))
    assert all(r["shard"] == r["slot"] // 32 and r["byte_offset"] == r["slot"] % 32 * 32 for r in got)
    want = sorted(
        (-1 if d is None else d, i // 16, ids[i:i + 16])
        for d, t in rows for ids in [MODEL.encode(t or "") + [MODEL.eos_id()]] for i in range(0, len(ids), 16)
    )
    have = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["sequence"],
         np.frombuffer(bytes(r["record"]), "<u2")[:r["n_tokens"]].tolist()) for r in got
    )
    assert have == want and all(len(r["record"]) == 32 for r in got)
    files = sorted((tmp_path / "s").glob("part-*"))
    firsts = [pq.read_table(f).column("first_slot").to_pylist() for f in files]
    assert sum(firsts, []) == list(range(0, total, 32)) and len(files) > 1  # files in order are slots in order
    later = read_sequences(spark, str(tmp_path / "s"), from_slot=50).orderBy("slot").collect()
    assert later == got[50:]
    assert sorted(sequence_at(range(total), total, key=4).tolist()) == list(range(total))
