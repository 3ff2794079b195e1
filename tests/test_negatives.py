"""Negative sampling: properties, exact counts by brute force, and skew."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bindery.operators import negatives as neg
from bindery.operators.order import distinct_draws

COLUMNS = "cdr3 string, tcr_chain string, v_gene string, j_gene string, peptide string, mhc_a string, mhc_b string, mhc_class string, source string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def make(seed=1, n=260, hot=0.4):
    """Pairs in which one peptide, and one receptor, hold a large share of the rows."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("ACDEFGHIKL") for _ in range(9)) for _ in range(6)]
    peptides = []
    for b in bases:
        for _ in range(4):
            w = list(b)
            w[rng.randrange(9)] = "W"
            peptides.append("".join(w)[: rng.choice([8, 9, 9])])
    rows = set()
    while len(rows) < n:
        cdr3 = "CHOT" if rng.random() < 0.2 else f"CASS{rng.randrange(90)}F"
        pep = peptides[0] if rng.random() < hot else rng.choice(peptides)
        rows.add((cdr3, "TRB", f"V{rng.randrange(3)}", "J1", pep, rng.choice(["A", "B"]), "", "MHCI", "S"))
    return sorted(rows)


@pytest.fixture(scope="module")
def data(spark):
    rows = make()
    return rows, spark.createDataFrame(rows, COLUMNS)


def pools(rows, min_pairs=10):
    count = Counter(r[4] for r in rows)
    known = {(r[0], r[4]) for r in rows}
    out = {}
    for a in count:
        for g in ("test", "left-out"):
            src = {p for p in count if (count[p] >= min_pairs) == (g == "test") and p != a and edits(a, p) > 3}
            out[a, g] = {(r[0], r[2], r[3]) for r in rows if r[4] in src and (r[0], a) not in known}
    return count, known, out


def test_near_peptides(data):
    rows, df = data
    words = sorted({r[4] for r in rows})
    want = {(a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= 3}
    assert {tuple(r) for r in neg.near_peptides(df).collect()} == want


@pytest.mark.parametrize("threshold", [0, 1, 2, 4])
def test_near_peptides_other_thresholds(spark, threshold):
    rng = random.Random(threshold)
    words = sorted({"".join(rng.choice("AB") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    df = spark.createDataFrame([(w,) for w in words], "peptide string")
    want = {(a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= threshold}
    assert {tuple(r) for r in neg.near_peptides(df, threshold).collect()} == want


def test_pool_sizes(data):
    rows, df = data
    _, _, want = pools(rows)
    numbered = neg.number_pairs(df, [], 42, 10)
    donors = neg.number_donors(numbered, [], neg.RECEPTOR_KEY, 42)
    out = neg.left_out_donors(numbered, donors, [], neg.RECEPTOR_KEY, ["cdr3"], 3)
    got = {(r["peptide"], r["grp"]): r["pool"] for r in neg.pool_sizes(numbered, donors, out, []).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_negatives_come_from_the_pools(data):
    rows, df = data
    count, known, want = pools(rows)
    drawn = neg.negatives(df, max_ratio=None).collect()
    assert len({(r["cdr3"], r["v_gene"], r["j_gene"], r["peptide"]) for r in drawn}) == len(drawn)
    by_peptide = {}
    for r in drawn:
        assert (r["cdr3"], r["peptide"]) not in known and r["label"] == 0
        by_peptide.setdefault(r["peptide"], set()).add((r["cdr3"], r["v_gene"], r["j_gene"]))
    contexts = {(r[4], r[1], r[5], r[6], r[7]) for r in rows}
    assert {(r["peptide"], r["tcr_chain"], r["mhc_a"], r["mhc_b"], r["mhc_class"]) for r in drawn} <= contexts
    for a in count:
        t, lo = want[a, "test"], want[a, "left-out"]
        assert by_peptide.get(a, set()) <= t | lo
        # One pair draws distinct receptors; several may draw the same.
        least = max(min(len(t), 3), min(len(lo), 2))
        most = min(len(t), 3 * count[a]) + min(len(lo), 2 * count[a])
        assert least <= len(by_peptide.get(a, set())) <= most


def test_receptors_of_one_hot_peptide_are_met_in_many_places(spark, data):
    rows, df = data
    numbered = neg.number_pairs(df, [], 42, 10)
    donors = neg.number_donors(numbered, [], neg.RECEPTOR_KEY, 42)
    plan = neg.left_out_donors(numbered, donors, [], neg.RECEPTOR_KEY, ["cdr3"], 3)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join Inner" in line and "other#" in line]
    assert joins and all("part#" in line for line in joins)
    hot = Counter(r[4] for r in rows).most_common(1)[0][0]
    parts = numbered.where(F.col("peptide") == hot).select(F.pmod(F.xxhash64(*neg.RECEPTOR_KEY), F.lit(neg.PARTS)))
    assert parts.distinct().count() > neg.PARTS / 2


def test_receptors_between_two_near_peptides(spark):
    """First and last peptide near, one between far or not; a null key or peptide leaves nothing out."""
    near, far = ["AAAAAAAAA", "AAAAAAAAW", "WAAAAAAAA"], "CCCCCCCCC"
    bound = {"R1": near[:1], "R2": near[1:], "R3": near, "R4": [near[0], far, near[2]], "R5": [far], "R6": [near[0], None], None: near[:1]}
    rows = [(r, "TRB", "V1", "J1", p, "A", "", "MHCI", "S") for r, ps in bound.items() for p in ps]
    numbered = neg.number_pairs(spark.createDataFrame(rows, COLUMNS), [], 42, 1)
    donors = neg.number_donors(numbered, [], neg.RECEPTOR_KEY, 42)
    got = neg.all_near(numbered, donors, [], neg.RECEPTOR_KEY, 3).select("peptide", "cdr3").collect()
    want = {(p, r) for p in near for r in ("R1", "R2", "R3")} | {(far, "R5")}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_near_peptides_meet_a_receptor_once(spark):
    """The join with near peptides takes one row for each receptor, not one for each of its pairs."""
    rows = [(f"R{r}", "TRB", "V1", "J1", "A" * p + "W" + "A" * (8 - p), "A", "", "MHCI", "S") for r in range(20) for p in range(9)]
    numbered = neg.number_pairs(spark.createDataFrame(rows, COLUMNS), [], 42, 1)
    donors = neg.number_donors(numbered, [], neg.RECEPTOR_KEY, 42)
    plan = neg.left_out_donors(numbered, donors, [], neg.RECEPTOR_KEY, ["cdr3"], 3)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join Inner" in line and "other#" in line]
    assert joins and "first#" in text and plan.count() == 180


def test_draws_travel_as_numbers(spark, data, monkeypatch):
    """Before repeats are gone, a draw holds no text of peptide, receptor or context."""
    _, df = data
    seen = {}
    write = neg.nth_unlisted
    monkeypatch.setattr(neg, "nth_unlisted", lambda draws, listed, *a, **k: seen.update(draws=draws, listed=listed) or write(draws, listed, *a, **k))
    assert neg.negatives(df, max_ratio=None).count() > 0
    for name in ("draws", "listed"):
        assert {f.dataType.simpleString() for f in seen[name].schema} <= {"int", "bigint"}


def test_draws_are_distinct_within_a_pair_and_even_over_the_pool(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 7 as bigint) as k").where("k <= 6")
    sets = df.select("k", distinct_draws(F.col("k"), F.lit(6).cast("bigint"), 1, "id").alias("d")).collect()
    assert all(len(set(r["d"])) == r["k"] and set(r["d"]) <= set(range(6)) for r in sets)
    pairs = Counter(tuple(sorted(r["d"])) for r in sets if r["k"] == 2)
    assert len(pairs) == 15 and max(pairs.values()) < 2.2 * min(pairs.values())


def test_repeats_are_as_many_as_independent_draws_make(spark):
    """n pairs that draw k of P leave P (1 - (1 - k / P)^n) receptors of a pool."""
    far = [(f"CASS{i}F", "TRB", "V1", "J1", "WWWWWWWWW", "A", "", "MHCI", "S") for i in range(400)]
    near = [(f"CATT{i}F", "TRB", "V1", "J1", "AAAAAAAAA", "A", "", "MHCI", "S") for i in range(300)]
    drawn = neg.negatives(spark.createDataFrame(far + near, COLUMNS), max_ratio=None)
    got = {r["peptide"]: r["count"] for r in drawn.groupBy("peptide").count().collect()}
    for peptide, pool, n in (("AAAAAAAAA", 400, 300), ("WWWWWWWWW", 300, 400)):
        mean = pool * (1 - (1 - 3 / pool) ** n)
        assert abs(got[peptide] - mean) < 5 * (pool * (1 - 3 / pool) ** n) ** 0.5 + 1


def test_cap(data):
    rows, df = data
    assert neg.negatives(df, max_ratio=1).count() == len(rows)
    full = neg.negatives(df, max_ratio=None)
    some = neg.negatives(df, max_ratio=0.5)
    assert some.count() == len(rows) // 2
    assert some.exceptAll(full).isEmpty()


def test_repeatable_for_any_partitioning(data, spark):
    rows, df = data
    other = spark.createDataFrame(list(reversed(rows)), COLUMNS).repartition(7)
    assert neg.negatives(df).exceptAll(neg.negatives(other)).isEmpty()


def test_no_far_peptide_gives_empty_table_with_columns(spark):
    rows = [("C1", "TRB", "V", "J", "AAAAAAAAA", "A", "", "MHCI", "S"), ("C2", "TRB", "V", "J", "AAAAAAAAC", "A", "", "MHCI", "S")]
    df = spark.createDataFrame(rows, COLUMNS)
    drawn = neg.negatives(df)
    assert drawn.count() == 0 and "label" in drawn.columns
    assert neg.labelled(df, drawn).count() == 2
    assert "source" not in neg.labelled(df, drawn).columns


def test_parts_do_not_mix(data):
    rows, df = data
    parted = df.withColumn("split", F.when(F.col("peptide") < "F", "a").otherwise("b"))
    drawn = neg.negatives(parted, by=["split"], max_ratio=None).collect()
    for part in ("a", "b"):
        own = [r for r in rows if ("a" if r[4] < "F" else "b") == part]
        _, _, want = pools(own)
        for r in (r for r in drawn if r["split"] == part):
            assert (r["cdr3"], r["v_gene"], r["j_gene"]) in want[r["peptide"], "test"] | want[r["peptide"], "left-out"]


def test_ratio_report(spark):
    pos = spark.createDataFrame([("p",)] * 3 + [("q",)] * 2, "peptide string")
    drawn = spark.createDataFrame([("p",)] * 7, "peptide string")
    got = [tuple(r) for r in neg.ratio_report(pos, drawn).collect()]
    assert got == [("q", 2, 0, 0.0), ("p", 3, 7, 2.33)]
    assert tuple(neg.overall_ratio(neg.ratio_counts(pos, drawn)).first()) == (5, 7, 1.4)


def test_random_swaps_never_hit_a_known_pair(spark):
    rows = [(f"C{i % 5}", f"P{i % 7}") for i in range(30)] + [("CHOT", f"P{i}") for i in range(7)]
    df = spark.createDataFrame(sorted(set(rows)), "cdr3 string, peptide string")
    known = set(rows)
    got = neg.random_swaps(df, 3).collect()
    assert len(got) == len(known)
    for r in got:
        # CHOT binds everything, so it may be given anything.
        assert r["cdr3"] in ("CHOT",) or (r["cdr3"], r["negative"]) not in known or len({p for c, p in known if c == r["cdr3"]}) == 7


def test_shuffled_pairs_keep_both_margins(data):
    rows, df = data
    got = neg.shuffled_pairs(df).collect()
    for i in (0, 1):
        zero = Counter(r[i] for r in got if r["label"] == 0)
        assert zero == Counter(r[i] for r in got if r["label"] == 1)


def test_paired(spark):
    rng = random.Random(5)
    peps = ["AAAAAAAAA", "AAAAAAAAC", "DDDDDDDDD", "EEEEEEEEE"]
    rows = sorted({(f"A{rng.randrange(9)}", f"B{rng.randrange(9)}", "VA", f"JA{rng.randrange(2)}", "VB", "JB", rng.choice(peps), "H1") for _ in range(60)})
    df = spark.createDataFrame(rows, "cdr3a string, cdr3b string, va string, ja string, vb string, jb string, peptide string, hla string")
    known = {(r[0], r[1], r[6]) for r in rows}
    receptors = {(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows}
    got = neg.paired_negatives(df, 5).collect()
    assert got
    for r in got:
        assert (r["cdr3a"], r["cdr3b"], r["peptide"]) not in known
        assert (r["cdr3a"], r["cdr3b"], r["va"], r["ja"], r["vb"], r["jb"]) in receptors
        assert any(edits(r["peptide"], k[2]) > 3 for k in known if k[:2] == (r["cdr3a"], r["cdr3b"]))
    assert len({(r["cdr3a"], r["cdr3b"], r["va"], r["vb"], r["peptide"]) for r in got}) == len(got)


def test_swaps_send_the_whole_rows_once(spark):
    from bindery.operators.negatives import random_swaps

    rows = [("c1", "p1", "x"), ("c1", "p1", "x"), ("c1", None, "y"), (None, "p2", "z"), ("c2", "p2", "z"), ("c3", None, "w"), ("c1", "p3", "v")]
    out = random_swaps(spark.createDataFrame(rows, "cdr3 string, peptide string, note string"))
    got = [tuple(r) for r in out.collect()]
    assert sorted(str(r[:3]) for r in got) == sorted(str(r) for r in rows if r[0] in ("c1", "c2"))
    # a null peptide is a word like any other, which no receptor counts as known
    assert all(r[3] in ({"p2", None} if r[0] == "c1" else {"p1", "p3", None}) for r in got)
    assert len({r[3] for r in got if r[:3] == ("c1", "p1", "x")}) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("note#") and "Window" not in "".join(x for x in plan.splitlines() if "note#" in x)


def test_a_hot_peptide_is_numbered_as_with_all_columns(spark):
    """With ``keep`` the other columns stay at home, but pairs that a null makes alike are told apart by all."""
    rows = [(f"C{i}", "TRB", "V1", "J1", "PEP" if i % 5 else None, "A", None if i % 3 else "B", "MHCI", f"S{i % 2}") for i in range(200)]
    rows += [("D", "TRB", "V1", "J1", "PEP", a, b, "MHCI", "S") for a, b in ((None, "X"), ("X", None))]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = neg.number_pairs(df, [], 42, 10).drop("tcr_chain", "mhc_class", "source", "mhc_b")
    slim = neg.number_pairs(df, [], 42, 10, ["cdr3", "v_gene", "j_gene", "mhc_a"])
    assert "source" not in slim.columns
    columns = sorted(slim.columns)
    assert sorted(whole.columns) == columns
    told = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert told(whole) == told(slim)
