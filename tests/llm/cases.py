"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, other columns."""

import random

ODD_TEXTS = [
    None, "", " ", "\n", "a", "word", "two words", "  lead and trail  ", "x" * 5000,
    "tab\tfeed\x0bform\x0c nbsp end", "Ünïcode ÉCOLE straße", "é combining", "日本語 テスト 😀",
    "▁mark \x01 \x02 control", "<|endoftext|> <|ENDOFTEXT|> </s> [INST]", "don't we'll I'VE",
    " ".join(["again"] * 300), "line one\nline two\n\nline four",
]
CLASHING = "part key node pack bucket guest band item shard slot id text2 __key tree"


def odd_rows():
    """(doc_id, text, and columns with names that operators use inside)."""
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None, None), (None, None, None, None, None, None)]
    rows += [(3, "a second text of one id", "en", "s", 2, "y")]
    return rows


def odd_documents(spark):
    df = spark.createDataFrame(
        odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint, part string"
    )
    for name in CLASHING.split()[1:]:
        df = df.withColumn(name, df["part"])
    return df


def no_documents(spark):
    return odd_documents(spark).where("false")


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def prose(seed, n_words, vocabulary=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n_words))
