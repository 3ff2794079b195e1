"""Joins by key: strictness, first rows, hot keys, user functions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindery.operators import lookup as lk
from bindery.operators import report as rp


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("HOT" if i % 3 == 0 else f"C{i % 200}", f"P{i % 7}", i) for i in range(900)]
    return spark.createDataFrame(rows, "cdr3 string, peptide string, n int")


def store(spark, keys, column):
    return spark.createDataFrame([(k, [float(len(k)), 1.0]) for k in keys], f"{column} string, vec array<float>")


def test_hot_keys(pairs):
    assert lk.hot_keys(pairs, ["cdr3"]) == [("HOT",)]
    assert sorted(lk.hot_keys(pairs, ["peptide"])) == [(f"P{i}",) for i in range(7)]
    assert lk.hot_keys(pairs.filter("n < 0"), ["cdr3"]) == []


@pytest.mark.parametrize("share", [16, 100, 400])
def test_no_hot_key_is_missed(spark, share):
    """Against exact counts, on shares that fall slowly past the limit; null is a key too."""
    rng = random.Random(share)
    rows = []
    for i in range(30_000):
        k = min(int(1 / max(1e-4, rng.random()) ** 0.8), 5000)
        rows.append((f"k{k}" if k > 1 else None, k % 3, rng.randrange(10**6)))
    df = spark.createDataFrame(rows, "a string, b int, c int").repartition(6)
    for key in (["a"], ["a", "b"], ["c"]):
        counts = df.groupBy(*key).count().where(f"count * {share} > {len(rows)}").collect()
        assert set(lk.hot_keys(df, key, share)) == {tuple(r)[:-1] for r in counts}
    both = lk.hot_keys_by(df, {"x": ["a"], "y": ["b"]}, share)
    assert set(both["x"]) == set(lk.hot_keys(df, ["a"], share)) and len(both["y"]) == 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, pairs, how):
    right = store(spark, ["HOT", "C1", "C2", "Cx"], "cdr3")
    plain = pairs.join(right, "cdr3", how)
    spread = lk.spread_join(pairs, right, ["cdr3"], how)
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_hot_key_is_spread(spark, pairs):
    with_parts = lk.spread_join(
        pairs, store(spark, ["HOT"], "cdr3").hint("shuffle_merge"), ["cdr3"]
    ).select(F.spark_partition_id().alias("p"), "cdr3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert with_parts.filter("cdr3 = 'HOT'").select("p").distinct().count() >= 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_strict_and_drop(spark, pairs):
    receptors = store(spark, ["HOT"] + [f"C{i}" for i in range(200) if i != 4], "cdr3")
    peptides = store(spark, [f"P{i}" for i in range(7)], "peptide")
    with pytest.raises(KeyError, match="Examples: C4"):
        lk.with_vectors(pairs, receptors, peptides)
    found = lk.with_vectors(pairs, receptors, peptides, drop_missing=True)
    lost = pairs.filter("cdr3 = 'C4'").count()
    assert found.count() == pairs.count() - lost > 0
    one = lk.feature_table(found).first()
    assert one["features"] == one["receptor_vec"] + [2.0, 1.0]
    cover = lk.vector_coverage(pairs, receptors, peptides).first()
    assert tuple(cover) == (900, 900 - lost, 900, 900 - lost)


def test_first_occurrence_and_residues(spark):
    rows = spark.createDataFrame([("a", 3, 0, [[1.0]]), ("a", 5, 1, [[2.0]]), ("b", 1, 0, [[9.0]])], "cdr3 string, o int, length int, residues array<array<float>>")
    assert {r["cdr3"]: r["o"] for r in lk.first_occurrence(rows, ["cdr3"], "o").collect()} == {"a": 3, "b": 1}
    need = spark.createDataFrame([("a",), ("b",), ("a",)], "cdr3 string")
    got = lk.with_residues(need, rows, ["cdr3"], "o").collect()
    assert [r["residues"] for r in got] == [[[2.0]], [[2.0]]]
    assert tuple(lk.dropped_rows(need, rows, ["cdr3"]).first()) == (3, 1)


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    right = spark.createDataFrame([(1, 1.0), (3, 0.0)], "id int, label double")
    assert [tuple(r) for r in lk.with_labels(left, right).collect()] == [(1, "a", 1)]
    with pytest.raises(ValueError, match="right"):
        lk.one_to_one(left, right.union(right), "id")
    with pytest.raises(ValueError, match="id column"):
        lk.with_labels(left.drop("id"), right)


def test_vector_lengths(spark):
    bad = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vec array<float>")
    with pytest.raises(ValueError):
        lk.checked_dim(bad)


def test_encode_distinct_runs_once_per_sequence(spark, pairs):
    def encoder(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_letters": s.str.len().astype("int32")})

    got = lk.encode_distinct(pairs, "cdr3", encoder, "n_letters int")
    assert got.count() == pairs.count() and got.filter("n_letters <> length(cdr3)").isEmpty()
    with pytest.raises(Exception, match="encoder gave"):
        lk.encode_distinct(pairs, "cdr3", lambda s: pd.DataFrame({"n_letters": [1]}), "n_letters int").collect()


def test_no_batch_passes_its_budget(spark):
    """One very long sequence is a batch by itself, and does not widen those of others."""
    words = ["A" * (1 + i % 40) for i in range(500)] + ["L" * 5000, "M" * 700]
    rows = spark.createDataFrame([(i, w + str(i), "P" * (i % 9)) for i, w in enumerate(words)], "n int, cdr3 string, peptide string")

    def encoder(s):
        padded = len(s) * s.str.len().max()
        assert padded <= 600 or len(s) == 1, padded
        return pd.DataFrame({"n_letters": s.str.len(), "batch": len(s)})

    got = lk.encode_distinct(rows, "cdr3", encoder, "n_letters int, batch int", budget=600).collect()
    assert len(got) == 502 and all(r["n_letters"] == len(r["cdr3"]) for r in got)
    assert max(r["batch"] for r in got) > 10 and {r["batch"] for r in got if r["n_letters"] > 600} == {1}

    def predict(frame):
        widths = sum(frame[c].str.len().max() for c in ("cdr3", "peptide"))
        assert len(frame) * widths <= 600 or len(frame) == 1
        return frame["cdr3"].str.len() * 1.0

    scored = lk.score_batches(lk.by_length(rows, "cdr3"), predict, ["cdr3", "peptide"], budget=600).collect()
    assert len(scored) == 502 and all(r["score"] == len(r["cdr3"]) for r in scored)
    frame = pd.DataFrame({"a": ["xx", "x", None, "xxxxx", "", "x"]})
    assert [len(f) for f in lk.within_budget(iter([frame, frame.iloc[:0]]), ["a"], 4)] == [2, 1, 1, 2]


def test_score_batches(pairs):
    got = lk.score_batches(pairs, lambda b: b["n"] * 2.0, ["n"])
    assert got.filter("score <> n * 2").isEmpty() and got.columns == [*pairs.columns, "score"]


def test_by_length_sorts_inside_partitions(spark):
    df = spark.createDataFrame([("A" * (i % 17 + 1) + str(i),) for i in range(300)], "s string")
    parts = lk.by_length(df, "s", 4).select(F.spark_partition_id().alias("p"), F.length("s").alias("n")).collect()
    by = {}
    for r in parts:
        by.setdefault(r["p"], []).append(r["n"])
    assert len(by) > 1 and all(v == sorted(v) for v in by.values())


def test_ledger(spark):
    old = spark.createDataFrame([("a", 0.1, 5), ("b", 0.2, 6)], "experiment_name string, auroc double, n_params int")
    new = spark.createDataFrame([("b", 0.9, 0.5)], "experiment_name string, auroc double, threshold double")
    got = rp.upsert(old, new)
    assert got.columns == ["experiment_name", "auroc", "threshold", "n_params"]
    assert sorted(map(str, map(tuple, got.collect()))) == ["('a', 0.1, None, 5)", "('b', 0.9, 0.5, None)"]
    assert rp.upsert(None, new) is new
    grid = spark.createDataFrame([("a", "x"), ("c", "x"), ("d", "y")], "experiment_name string, receptor_embedding string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(rp.missing_runs(grid, old)) == ["c", "d"]
    assert names(rp.missing_runs(grid, old, only=["x"])) == ["c"]
    assert names(rp.missing_runs(grid, old, force=True)) == ["a", "c", "d"]


def test_names(spark):
    df = spark.createDataFrame([("vae", "cat_ae"), ("one_hot", None)], "e string, c string")
    got = df.select(rp.experiment_name(F.col("e"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["vae_meta", "onehot"]
    with pytest.raises(Exception, match="unsupported embedding"):
        spark.range(1).select(rp.experiment_name(F.lit("nope"), F.lit("one_hot"))).collect()


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 2, 3, 5)], "x string")
    got = {r["bin"]: r["n_rows"] for r in rp.length_histogram(df, {"x": 2}).collect()}
    assert got == {0: 2, 1: 2}


def test_summary_exact_and_approximate(spark):
    df = spark.createDataFrame([("c", "p", "v", "j", "m", "S"), ("d", "p", "v", "j", None, "T")], "cdr3 string, peptide string, v_gene string, j_gene string, mhc_a string, source string")
    exact = {r["quantity"]: r["value"] for r in rp.dataset_summary(df).collect()}
    assert exact["rows"] == 2 and exact["unique cdr3"] == 2 and exact["unique mhc_a"] == 1 and exact["rows from T"] == 1
    assert {r["quantity"]: r["value"] for r in rp.dataset_summary(df, approximate=True).collect()} == exact


def test_equal_rows_of_a_hot_key_are_spread(spark):
    rows = lk.numbered_rows(spark.createDataFrame([("HOT",)] * 5000, "cdr3 string"))
    assert rows.select((rows["_row"] % lk.HOT_SHARE).alias("s")).distinct().count() == lk.HOT_SHARE
    right = spark.createDataFrame([("HOT", 1), ("x", 2)], "cdr3 string, v int")
    joined = lk.spread_join(rows.drop("_row"), right, ["cdr3"])
    assert joined.columns == ["cdr3", "v"] and joined.count() == 5000


def test_a_sequence_stored_twice_does_not_double_pairs(spark):
    pairs = spark.createDataFrame([("C1", "P1")], "cdr3 string, peptide string")
    receptors = spark.createDataFrame([("C1", [2.0], 2), ("C1", [1.0], 3), ("C1", [9.0], 1)], "cdr3 string, vec array<double>, at int")
    peptides = spark.createDataFrame([("P1", [5.0], 1)], "peptide string, vec array<double>, at int")
    assert [r["receptor_vec"] for r in lk.with_vectors(pairs, receptors, peptides).collect()] == [[1.0]]
    assert [r["receptor_vec"] for r in lk.with_vectors(pairs, receptors, peptides, order="at").collect()] == [[9.0]]
