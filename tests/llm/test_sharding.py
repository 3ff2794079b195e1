import pytest

from bindery.llm.sharding import extendible_shards

from .cases import frame, no_documents, odd_documents


def check(rows, limit, n):
    assert len(rows) == n
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for name, own in shards.items():
        assert len(name) == own[0]["depth"] and own[0]["shard_rows"] == len(own)
        assert own[0]["shard_bytes"] == sum(r["n_bytes"] for r in own)
        assert own[0]["shard_bytes"] <= limit or len(own) == 1
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    return shards


def test_only_large_buckets_split(spark):
    rows = [(i, "x" * (1 + i % 50)) for i in range(2000)]
    shards = check(extendible_shards(frame(spark, rows), limit=2000).collect(), 2000, 2000)
    for name, own in shards.items():  # the parent of a shard was too large
        if name:
            family = [r for s, rs in shards.items() if s.startswith(name[:-1]) for r in rs]
            assert sum(r["n_bytes"] for r in family) > 2000


@pytest.mark.parametrize("text", [lambda i: f"text {i}", lambda i: "the same text"])
def test_one_key_with_a_third_of_the_rows_is_split(spark, text):
    rows = [(7, text(i)) for i in range(500)] + [(100 + i, "other text") for i in range(1000)]
    check(extendible_shards(frame(spark, rows), limit=300).collect(), 300, 1500)


def test_odd_rows(spark):
    df = odd_documents(spark)
    check(extendible_shards(df, limit=100).collect(), 100, df.count())
    assert {r["shard"] for r in extendible_shards(df, limit=1 << 30).collect()} == {""}


def test_no_rows(spark):
    assert extendible_shards(no_documents(spark)).collect() == []
