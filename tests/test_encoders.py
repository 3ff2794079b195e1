"""One-hot vectors of sequences: shape, one per position, padding, cutting, decoding."""

import pytest
from pyspark.sql import functions as F

from bindery.constants import PEPTIDE_LENGTH, RECEPTOR_LENGTH
from bindery.functions import text as tx
from bindery.functions import vectors as vx
from bindery.operators import features as ft

RECEPTORS = ["CASSLAPGATNEKLFF", "CASSPGTASYNEKLFF", "CASSLGQAYEQYF", "CASSQDRGTEAFF", "CASSGLAGGYNEQFF"]
PEPTIDES = ["GILGFVFTL", "NLVPMVATV", "GLCTLVAML", "ELAGIGILTV", "SIINFEKL"]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(RECEPTORS, PEPTIDES)), "cdr3 string, peptide string")


@pytest.fixture(scope="module")
def encoded(pairs):
    return {r["cdr3"]: r for r in ft.one_hot_pairs(pairs).collect()}


def blocks(vec):
    return [vec[i:i + 22] for i in range(0, len(vec), 22)]


def test_dimensions(encoded):
    for r in encoded.values():
        assert len(r["receptor_vec"]) == RECEPTOR_LENGTH * 22 == 660
        assert len(r["peptide_vec"]) == PEPTIDE_LENGTH * 22 == 330


def test_one_per_position(encoded):
    for r in encoded.values():
        assert all(sum(b) == 1 and set(b) <= {0.0, 1.0} for b in blocks(r["receptor_vec"]) + blocks(r["peptide_vec"]))


def test_padding_uses_symbol_zero(encoded):
    for cdr3, r in encoded.items():
        assert all(b[0] == 1 for b in blocks(r["receptor_vec"])[len(cdr3):])
        assert all(b[0] == 0 for b in blocks(r["receptor_vec"])[:len(cdr3)])


def test_distinct_and_repeatable(pairs, encoded):
    vectors = {tuple(r["receptor_vec"]) for r in encoded.values()}
    assert len(vectors) == len(RECEPTORS)
    again = {r["cdr3"]: r for r in ft.one_hot_pairs(pairs).collect()}
    assert again == encoded


def test_unknown_and_long(spark):
    df = spark.createDataFrame([("AZ" + "C" * 40,), ("",)], "s string")
    ids = [r[0] for r in df.select(tx.residue_ids("s", 30)).collect()]
    assert ids[0][:3] == [1, 21, 2] and len(ids[0]) == 30
    assert ids[1] == [0] * 30
    masks = [r[0] for r in df.select(tx.residue_mask("s", 30)).collect()]
    assert [sum(m) for m in masks] == [30, 0]


def test_decode(encoded, spark):
    df = spark.createDataFrame([(r["receptor_vec"], c) for c, r in encoded.items()], "v array<float>, c string")
    assert all(r[0] == r[1] for r in df.select(vx.decode_one_hot("v", 30), "c").collect())


def test_sparse_equals_dense(pairs, encoded):
    for r in ft.sparse_pair_features(pairs).collect():
        dense = encoded[r["cdr3"]]["receptor_vec"] + encoded[r["cdr3"]]["peptide_vec"]
        assert list(r["features"].toArray()) == dense
        assert len(r["features"].indices) == 45


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    with pytest.raises(Exception, match="vector length"):
        df.select(vx.unfold("v", 3, 2)).collect()


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(
        [("TRBV2", "TRBJ1", "MHCI"), ("TRBV1", "TRBJ2", "MHCII"), ("TRBV1", None, None)],
        "v_gene string, j_gene string, mhc_class string",
    )


def test_categories(genes, spark):
    cats = ft.Categories.fit(genes)
    assert cats.breakdown() == {"mhc_class": 1, "v_gene": 2, "j_gene": 2} and cats.feature_dim == 5
    new = spark.createDataFrame([("TRBV1", "TRBJ2", "MHCII"), ("TRBV9", None, None)], genes.schema)
    got = {r["v_gene"]: list(r["meta"]) for r in cats.transform(new).collect()}
    assert got == {"TRBV1": [1, 1, 0, 0, 1], "TRBV9": [0, 0, 0, 0, 0]}


def test_categories_round_trip(genes, spark, tmp_path):
    cats = ft.Categories.fit(genes)
    cats.save(str(tmp_path / "v"))
    again = ft.Categories.load(spark, str(tmp_path / "v"), ["v_gene", "j_gene"])
    assert again.sizes == cats.sizes
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, cats.table.collect()))


def test_sparse_with_categories(pairs, genes):
    rows = pairs.withColumns({"v_gene": F.lit("TRBV1"), "j_gene": F.lit("none"), "mhc_class": F.lit("MHCII")})
    vec = ft.sparse_pair_features(rows, ft.Categories.fit(genes)).first()["features"]
    assert vec.size == 990 + 5 and list(vec.toArray()[990:]) == [1, 1, 0, 0, 0]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 4.0], [3.0, 2.0], [5.0, 0.0]], 0, 2), ([], 0, 0), (None, None, None)],
                               "r array<array<float>>, s int, e int")
    got = df.select(vx.mean_pool(vx.span("r", "s", "e")), vx.max_pool("r"), vx.kept_length("r", 2)).collect()
    assert [tuple(r) for r in got] == [([2.0, 3.0], [5.0, 4.0], 2), (None, None, 0), (None, None, 0)]
    mask = F.array(F.lit(1), F.lit(0), F.lit(1))
    assert df.select(vx.masked_mean("r", mask, 2)).first()[0] == [3.0, 2.0]


def test_paired_and_beta(spark):
    df = spark.createDataFrame([([[1.0], [2.0]], [[3.0], [4.0]]), (None, [[3.0]])], "a array<array<float>>, b array<array<float>>")
    both = df.select("a", "b", vx.paired_residues(F.col("a"), F.col("b"), 3).alias("ab"), F.coalesce(F.size("a"), F.lit(0)).alias("la"), F.size("b").alias("lb"))
    got = both.select("ab", vx.beta_slice("ab", F.greatest("la", F.lit(0)), "lb", 30)).collect()
    assert [tuple(r) for r in got] == [([[1.0], [2.0], [3.0]], [[3.0]]), ([[3.0]], [[3.0]])]


def test_edges(spark):
    df = spark.createDataFrame([("AB", "CDE")], "cdr3 string, peptide string")
    got = sorted((r["src"], r["dst"], r["etype"]) for r in ft.residue_edges(df, 4, 5).collect())
    one_way = [(0, 1, 0), (4, 5, 1), (5, 6, 1)] + [(i, 4 + j, 2) for i in range(2) for j in range(3)]
    assert got == sorted(one_way + [(b, a, t) for a, b, t in one_way])


def test_one_compressed_graph_per_pair(spark):
    df = spark.createDataFrame([("CAS", "GI", 1), ("C", "", 2), ("", "", 3), ("A" * 40, "G" * 20, 4), (None, "G", 5)], "cdr3 string, peptide string, n int")
    graph = ft.residue_graph(df, 30, 15)
    assert graph.count() == 5
    for r in graph.collect():
        if r["cdr3"] is None:
            assert r["nodes"] is None
            continue
        a, b = min(30, len(r["cdr3"])), min(15, len(r["peptide"]))
        assert r["nodes"] == [*range(a), *range(30, 30 + b)]
        want = {0: 2 * max(0, a - 1), 1: 2 * max(0, b - 1), 2: 2 * a * b}
        for t, n in want.items():
            offsets, targets = r[f"offsets_{t}"], r[f"targets_{t}"]
            assert len(offsets) == a + b + 1 and offsets[0] == 0 and offsets[-1] == len(targets) == n
            edges = {(s, d) for i, s in enumerate(r["nodes"]) for d in targets[offsets[i]:offsets[i + 1]]}
            assert len(edges) == n and edges == {(d, s) for s, d in edges}
    assert ft.graph_edges(graph).where("n = 4").count() == 986


def test_edges_are_made_once_for_each_pair_of_lengths(spark):
    """Same rows as the graph spelled out for every pair; repeats stay, empty and null texts have none."""
    rows = [("CAS", "GI"), ("CAS", "GI"), ("CASSF", "GILGFV"), ("", "GI"), ("C", ""), (None, "GI"), ("CAS", None)]
    df = spark.createDataFrame(rows, "cdr3 string, peptide string")
    edges = ft.residue_edges(df, 4, 5)
    want = ft.graph_edges(ft.residue_graph(df, 4, 5))
    assert edges.columns == want.columns and edges.count() == want.count() > 0
    assert edges.exceptAll(want).isEmpty() and want.exceptAll(edges).isEmpty()
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "broadcast" in plan


def test_a_fitted_vocabulary_is_written_once(spark):
    from bindery.operators.features import Categories

    rows = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y")], "v_gene string, j_gene string")
    cats = Categories.fit(rows)
    assert cats.table.inputFiles() and cats.sizes == {"v_gene": 2, "j_gene": 2}
    assert sorted(map(tuple, cats.table.collect())) == [("j_gene", "x", 0), ("j_gene", "y", 1), ("v_gene", "a", 0), ("v_gene", "b", 1)]


def test_ones_and_letters_are_read_by_batches(spark):
    """Nulls, empty vectors, nulls and equal numbers inside; none of it by a lambda over the numbers."""
    one = vx.one_hot_sequence("s", 4)
    rows = spark.createDataFrame([("ACD",), (None,), ("",), ("ZZZZZZ",), ("A",)], "s string").select("s", one.alias("v"))
    made = rows.select("s", vx.ones_text("v").alias("ones"), vx.decode_one_hot("v", 4).alias("cut"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "slice(" not in plan
    got = {r["s"]: (r["ones"], r["cut"]) for r in made.collect()}
    assert got["ACD"] == ("1,24,47,66", "ACD") and got[None] == (None, None) and got[""] == ("0,22,44,66", "")
    assert got["ZZZZZZ"][1] == "XXXX" and got["A"][1] == "A"
    odd = spark.createDataFrame([(1, [1.0, 0.5, 1.0, None, 2.0]), (2, []), (3, None)], "k int, v array<float>")
    assert [r[0] for r in odd.orderBy("k").select(vx.ones_text("v")).collect()] == ["0,2", "", None]
    with pytest.raises(Exception, match=r"vector length is not 4\*22: 5"):
        odd.select(vx.decode_one_hot("v", 4)).collect()
    even = spark.createDataFrame([([0.0, 0.5, None] + [0.5] * 19 + [None] * 22,)], "v array<float>")
    assert even.select(vx.decode_one_hot("v", 2)).first()[0] == "A"
