"""Ranks and running sums, with one group that holds most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bindery.operators import order as od


def hashed(seed, *parts):
    return hashlib.md5("|".join([str(seed), *map(str, parts)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(600)]
    return rows, spark.createDataFrame(rows, "grp string, id int")


def test_hash_is_plain_md5(spark):
    got = spark.range(1).select(od.hash_text(42, F.lit("a"), F.lit(7)).alias("h"), od.hash_int(42, F.lit("a")).alias("n")).first()
    assert got["h"] == hashed(42, "a", 7)
    assert got["n"] == int(hashed(42, "a")[:8], 16)


def test_hashed_rank(skewed):
    rows, df = skewed
    got = {(r["grp"], r["id"]): (r["rank"], r["n"]) for r in od.hashed_rank(df, ["grp"], ["id"], 1, "rank", "n").collect()}
    for grp in {g for g, _ in rows}:
        ids = sorted((i for g, i in rows if g == grp), key=lambda i: (hashed(1, i), i))
        for place, i in enumerate(ids, 1):
            assert got[(grp, i)] == (place, len(ids))


def test_hot_group_is_not_one_task(skewed):
    """The window of a rank runs per (group, cell): no exchange is keyed on the group alone."""
    _, df = skewed
    plan = od.hashed_rank(df, ["grp"], ["id"], 1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_hash" in line]
    assert windows and all("_cell" in line for line in windows)


@pytest.mark.parametrize("n", [0, 1, 17, 300, 600, 1000])
def test_take_hashed(skewed, n):
    rows, df = skewed
    got = {r["id"] for r in od.take_hashed(df, n, ["id"], 5).collect()}
    want = sorted((i for _, i in rows), key=lambda i: (hashed(5, i), i))[:n]
    assert got == set(want)


def test_running_totals_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 5), ("b", 1, 7)], "g string, k int, v int")
    df = df.withColumn("cell", F.col("k"))
    got = od.running_totals(df, ["g"], "cell", ["k", "v"], {"run": F.col("v")}, {"run": "total"})
    assert sorted((r["g"], r["v"], r["run"], r["total"]) for r in got.collect()) == [
        ("a", 2, 2, 10), ("a", 3, 5, 10), ("a", 5, 10, 10), ("b", 7, 7, 7)]


@pytest.mark.parametrize("cells", [1, 4, 256])
def test_nth_unlisted(spark, cells):
    rng = random.Random(3)
    draws, listed, want = [], [], set()
    for g, size in (("x", 50), ("y", 7), ("z", 200)):
        out = sorted(rng.sample(range(size), size // 3))
        free = [p for p in range(size) if p not in out]
        listed += [(g, p, size) for p in out]
        for r in range(0, len(free), 2):
            draws.append((g, size, r))
            want.add((g, r, free[r]))
    draws.append(("none", 5, 3))
    want.add(("none", 3, 3))
    got = od.nth_unlisted(
        spark.createDataFrame(draws, "g string, size int, r int"),
        spark.createDataFrame(listed, "g string, pos int, size int"),
        ["g"], "size", "r", "pos", cells,
    )
    assert {(r["g"], r["r"], r["pos"]) for r in got.collect()} == want


def test_ordered_rank_and_step(spark):
    df = spark.createDataFrame([(i * i % 1009,) for i in range(1, 500)], "k int").distinct()
    keys = sorted(r[0] for r in df.collect())
    got = {r["k"]: r["rank"] for r in od.ordered_rank(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(keys, 1)}
    assert sorted(r[0] for r in od.every_nth(df, "k", 10).collect()) == keys[::10]


def test_value_cells_are_monotone_and_even(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    cut = od.with_value_cell(df, "v", "c", od.value_cuts(df, "v", 10))
    rows = [r["c"] for r in cut.orderBy("v").collect()]
    assert rows == sorted(rows)
    assert max(rows.count(c) for c in set(rows)) <= 150


def test_a_null_group_keeps_its_rows(spark):
    from bindery.operators.split import stratified_folds, stratified_val

    rows = [("a", 1), ("a", 2), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "peptide string, n int")
    assert sorted(r["n"] for r in stratified_val(df).collect()) == [1, 2, 3, 4]
    folds = stratified_folds(df, "peptide", 2, ["n"]).collect()
    assert sorted((str(r["peptide"]), r["fold"]) for r in folds) == [("None", 0), ("None", 1), ("a", 0), ("a", 1)]


def test_rows_are_dealt_once_for_a_rank_without_groups(spark):
    """The join with the cells takes the rows as the window dealt them; null keys rank too."""
    df = spark.createDataFrame([(i if i % 5 else None,) for i in range(300)], "id int")
    ranked = od.hashed_rank(df, [], ["id"], 1, "rank", "n")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 301))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = od.hashed_rank(df, [], ["id"], 1, "rank", "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "coalesce(_cell" not in plan and "isnull(_cell" not in plan


def test_cells_of_each_group_change_no_position(spark):
    from bindery.operators.order import nth_unlisted

    struck = {"a": [0, 1, 5], "b": [2], "c": []}
    size, cells = {"a": 9, "b": 6, "c": 4}, {"a": 1, "b": 3, "c": 4096}
    draws = [(g, w, size[g], cells[g]) for g in size for w in range(size[g] - len(struck[g]))]
    listed = [(g, p, size[g], cells[g]) for g in size for p in struck[g]]
    df = nth_unlisted(
        spark.createDataFrame(draws, "g string, want bigint, n bigint, k int"),
        spark.createDataFrame(listed, "g string, pos bigint, n bigint, k int"), ["g"], "n", "want", "pos", cells="k", no_nulls=True,
    )
    got = sorted((r["g"], r["want"], r["pos"]) for r in df.collect())
    free = {g: [p for p in range(size[g]) if p not in struck[g]] for g in size}
    assert got == [(g, w, p) for g in sorted(free) for w, p in enumerate(free[g])]


def test_rows_of_a_limited_group_stay_where_they_are(skewed, spark):
    """Only the rows of the one cell that a limit cuts are dealt out."""
    rows, df = skewed
    limits = spark.createDataFrame([("hot", 17), ("g0", 10**6), ("g1", 0)], "grp string, most int")
    taken = od.take_hashed_by(df, limits, ["grp"], ["id"], 5, "most")
    want = {}
    for grp, most in (("hot", 17), ("g0", 10**6), ("g1", 0)):
        ids = sorted((i for g, i in rows if g == grp), key=lambda i: (hashed(5, i), i))
        want |= {i: grp for i in ids[:most]}
    assert {r["id"]: r["grp"] for r in taken.collect()} == want
    plan = taken.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # for the window over the rows of that cell


def test_draws_are_dealt_once_and_kept_once(spark, monkeypatch):
    """Draws are not written to be counted; of those that want one entry the first stays."""
    written = []
    plain = od.staged
    monkeypatch.setattr(od, "staged", lambda df, label="table", by=(): written.append(df.columns) or plain(df, label, by))
    draws = [("a", i, w, 9, 3) for i, w in enumerate([0, 5, 5, 0, 2, 5])]
    listed = [("a", p, 9, 3) for p in (0, 1, 5)]
    df = od.nth_unlisted(
        spark.createDataFrame(draws, "g string, i int, want bigint, n bigint, k int"),
        spark.createDataFrame(listed, "g string, pos bigint, n bigint, k int"), ["g"], "n", "want", "pos", cells="k", once="i",
    )
    assert sorted((r["want"], r["i"], r["pos"]) for r in df.collect()) == [(0, 0, 2), (2, 4, 4), (5, 1, 8)]
    assert written and not any("i" in columns for columns in written)
