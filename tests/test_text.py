"""Text expressions against the same rules written in Python."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bindery.constants import SPAN_TERMINALS
from bindery.functions import text as tx

CLASSES = {
    "HLA-A*02:01": ("MHCI", "MHCI"), "hla-b*07:02 ": ("MHCI", "MHCI"), "HLA-DRB1*04:01": ("MHCII", "MHCII"),
    "HLA class I": ("MHCI", "MHCI"), "HLA class II": ("", "MHCII"), "B2M": ("MHCI", "MHCI"), "": ("", ""), None: ("", ""),
    "HLA-A*01:01, HLA-DQ": ("", ""), "H2-Kb": ("", ""),
}


@pytest.fixture(scope="module")
def one(spark):
    def run(values, *exprs):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [tuple(r)[1:] for r in df.select("x", *[e.alias(f"e{i}") for i, e in enumerate(exprs)]).collect()]
    return run


def test_strip_takes_all_white_space(one):
    values = [" a ", "\tb\n", None, "", "c d", "\xa0e\u2003"]
    got = one(values, tx.strip("x"))
    assert [g[0] for g in got] == [(v or "").strip() for v in values]


def test_mhc_class(one):
    got = one(list(CLASSES), tx.mhc_class("x"), tx.mhc_class("x", True))
    assert got == list(CLASSES.values())


def test_preclean_gene(one):
    cases = {
        "TRBV1-4:01": "TRBV1-4*01", "TRBV12-3/4": "TRBV12-3", "TCRBV3-1 or TCRBV3-2": "TCRBV3-1", "TRBV29/DV5": "TRBV29",
        "A:1:2": "A*1*2", "X OR y": "X", "": "", "TRBV:x": "TRBV:x",
    }
    assert [g[0] for g in one(list(cases), tx.preclean_gene("x"))] == list(cases.values())


def test_gaps_and_locate(one):
    got = one(["a-b.c ", None, "--"], tx.strip_gaps("x"), tx.locate(F.lit("XXABC"), tx.strip_gaps("x")))
    assert got == [("ABC", 2), ("", -1), ("", -1)]


def span_by_hand(full, core):
    core = core.upper()
    tries = [core] + ([] if core.startswith("C") else ["C" + core])
    for t in SPAN_TERMINALS:
        tries += [core + t] + ([] if core.startswith("C") else ["C" + core + t])
    for t in tries:
        if t in full:
            return full.index(t), full.index(t) + len(t)
    return None


def test_core_span(spark):
    rows = [("MKCASSFGEG", "CASSF"), ("MKCASSFGEG", "ASS"), ("MKCASSFGEG", "assf"), ("MKXX", "CASS"), ("QQCAWW", "CAW"), ("AFA", "A")]
    df = spark.createDataFrame(rows, "full string, core string")
    got = [tuple(r["s"]) if r["s"] else None for r in df.select("full", tx.core_span("full", "core").alias("s")).collect()]
    assert got == [span_by_hand(*r) for r in rows]
    cut = df.select(tx.core_span("full", "core").alias("s"), "full").select(tx.cut_span("full", "s.start", "s.end")).collect()
    assert [r[0] for r in cut] == [f[slice(*span_by_hand(f, c))] if span_by_hand(f, c) else None for f, c in rows]


def by_hand(word, depth):
    out = set()
    for d in range(min(depth, len(word)) + 1):
        for gone in combinations(range(len(word)), d):
            out.add("".join(ch for i, ch in enumerate(word) if i not in gone))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_deletions(one, depth):
    words = ["ABCDE", "AAAA", "AB", "A", "GILGFVFTL"]
    got = one(words, tx.deletions(F.col("x"), depth))
    assert [set(g[0]) for g in got] == [by_hand(w, depth) for w in words]


def test_wildcards_and_scheme(one):
    got = one(["AX", "A*", "A?", "AB", "https://q/1 "], tx.has_wildcard("x"), tx.same_scheme("x"))
    assert [g[0] for g in got] == [True, True, True, False, False]
    assert got[4][1] == "http://q/1"


def test_choose_nonempty(spark):
    df = spark.createDataFrame([("a", "b"), (" ", "b "), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(tx.choose_nonempty("x", "y")).collect()] == ["a", "b", ""]


def test_core_span_is_compiled(spark):
    from bindery.functions.text import core_span

    rows = spark.createDataFrame([("MCASSFG", "ass"), ("MCASSFG", "CAS"), ("MCASSFG", "Q"), ("MG", ""), (None, "A"), ("MG", None)], "full string, core string")
    df = rows.select("full", "core", core_span("full", "core").alias("s"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["s"]["start"], r["s"]["end"]) if r["s"] else None for r in df.collect()]
    assert got == [(2, 5), (1, 4), None, (0, 0), None, None]
