"""Splits: disjoint on the key, complete, right sizes."""

import pytest
from pyspark.sql import functions as F

from bindery.operators import split as sp


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(f"C{i % 37}", "PHOT" if i % 3 == 0 else f"P{i % 23}", i) for i in range(400)]
    return spark.createDataFrame(rows, "cdr3 string, peptide string, n int")


@pytest.mark.parametrize("key,test,val", [("peptide", 0.2, 0.1), ("cdr3", 0.15, 0.25), ("cdr3", 0.001, 0.001)])
def test_holdout(pairs, key, test, val):
    rows = sp.holdout(pairs, key, test, val).collect()
    assert len(rows) == pairs.count()
    keys = {s: {r[key] for r in rows if r["split"] == s} for s in ("train", "val", "test")}
    n = len(set().union(*keys.values()))
    assert sum(map(len, keys.values())) == n
    assert len(keys["test"]) == max(1, round(n * test)) and len(keys["val"]) == max(1, round(n * val))


def test_holdout_moves_no_rows(pairs):
    plan = sp.holdout(pairs, "peptide")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_holdout_of_nothing(pairs):
    with pytest.raises(ValueError):
        sp.holdout(pairs.filter("n < 0"), "peptide")


def test_few_keys(spark):
    two = spark.createDataFrame([("a",), ("b",)], "peptide string")
    assert sorted(r["split"] for r in sp.holdout(two, "peptide").collect()) == ["test", "val"]
    one = spark.createDataFrame([("a",)], "peptide string")
    assert [r["split"] for r in sp.holdout(one, "peptide").collect()] == ["test"]


def test_random_split(pairs):
    counts = {r["split"]: r["count"] for r in sp.random_split(pairs, 0.2, 0.1).groupBy("split").count().collect()}
    assert counts == {"test": 80, "val": 40, "train": 280}


def test_random_split_moves_no_rows_unless_copies_straddle_a_cut(pairs):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(sp.random_split(pairs))
    copies = pairs.select(F.lit("a").alias("cdr3"), F.lit("p").alias("peptide"))
    done = sp.random_split(copies)
    assert "Exchange" in plan(done)
    assert {r["split"]: r["count"] for r in done.groupBy("split").count().collect()} == {"test": 80, "val": 40, "train": 280}
    assert sp.random_split(pairs.filter("n < 0")).count() == 0


def test_stratified_val(pairs, spark):
    rows = sp.stratified_val(pairs, 0.1).groupBy("peptide").agg(
        F.count("*").alias("n"), F.sum((F.col("split") == "val").cast("int")).alias("v")
    ).collect()
    for r in rows:
        assert r["v"] == max(1, round(r["n"] * 0.1))
    tiny = spark.createDataFrame([("a",), ("b",), ("b",)], "peptide string")
    got = {(r["peptide"], r["split"]) for r in sp.stratified_val(tiny, 0.9).collect()}
    assert got == {("a", "val"), ("b", "val"), ("b", "train")}


def test_folds(pairs):
    rows = sp.stratified_folds(pairs, "peptide", 5, ["n"]).groupBy("peptide", "fold").count().collect()
    by = {}
    for r in rows:
        by.setdefault(r["peptide"], []).append(r["count"])
    assert all(max(c) - min(c) <= 1 for c in by.values() if len(c) == 5)


def test_balanced_and_stratified(pairs):
    got = sp.balanced_subset(pairs, "peptide", 3, 12, ["n"]).groupBy("peptide").count().collect()
    assert len(got) == 3 and {r["count"] for r in got} == {12}
    rows = pairs.withColumn("vec", F.when(F.col("n") != 5, F.array(F.lit(1.0))))
    assert sp.stratified_sample(rows, 48, "peptide", "vec", ["n"]).groupBy("peptide").count().filter("count <> 2").isEmpty()
    assert sp.stratified_sample(rows, 1000, "peptide", "vec", ["n"]).count() == 399
    assert sp.stratified_sample(rows, 50, "peptide", "vec", ["n"], stratify=False).count() == 50


def test_stats_and_assign(pairs, spark):
    stats = {r["split"]: r for r in sp.split_stats(sp.holdout(pairs, "peptide")).collect()}
    assert sum(r["n_rows"] for r in stats.values()) == 400
    keys = spark.createDataFrame([("PHOT", "test")], "peptide string, split string")
    got = sp.assign_by_key(pairs, keys, "peptide")
    assert got.count() == 134 and got.select("split").distinct().count() == 1


def test_split_queries_make_the_view_once(spark, folder, monkeypatch):
    from catalog import split, views

    made, plain = [], views.staged
    monkeypatch.setattr(views, "staged", lambda df, label: made.append(label) or plain(df, label))
    for query in (split.q_split_by_peptide, split.q_split_by_receptor, split.q_split_random, split.q_split_stats):
        plan = query(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert made.pop() == "positives" and not made and "Join" not in plan
