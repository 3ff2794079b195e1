"""Cleaning of small raw tables with known answers."""

import pytest
from pyspark.sql import functions as F

from bindery.operators import clean as cl
from bindery.operators import stitch as st

VDJ = ["gene", "cdr3", "v.segm", "j.segm", "species", "mhc.a", "mhc.b", "mhc.class", "antigen.epitope", "vdjdb.score"]
GOOD = ("TRB", " CASSF ", "TRBV1:01", "TRBJ1*01 or x", "HomoSapiens", "HLA-A*02", "B2M", "MHCI", "GIL", 1)


def vdjdb(spark, *changes):
    rows = []
    for change in ({}, *changes):
        rows.append(tuple(change.get(c, v) for c, v in zip(VDJ, GOOD)))
    schema = ", ".join(f"`{c}` {'int' if c == 'vdjdb.score' else 'string'}" for c in VDJ)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(
        [("TRBV1*01", "TRBV1*01", True), ("TRBJ1*01", "TRBJ1*01", True), ("TRBV2", "TRBV2*01", False)],
        "symbol string, allele string, functional boolean",
    )


def steps(df):
    return {r["step"]: r["n_rows"] for r in df.collect()}


def test_vdjdb(spark, ref):
    raw = vdjdb(
        spark, {"species": "Mouse"}, {"gene": "TRA"}, {"mhc.b": None}, {"cdr3": "CAX"}, {"vdjdb.score": 0},
        {"vdjdb.score": None}, {"v.segm": "TRBV2"}, {"v.segm": "TRBV1*01/7"}, {"antigen.epitope": ""},
    )
    marked = cl.mark_vdjdb(raw, ref)
    rows = cl.clean_rows(marked, "VDJdb").collect()
    assert [tuple(r) for r in rows] == [("CASSF", "TRB", "TRBV1*01", "TRBJ1*01", "GIL", "HLA-A*02", "B2M", "MHCI", "VDJdb")]
    assert steps(cl.funnel(marked, "VDJdb")) == {
        "loaded_rows": 10, "after_species": 9, "after_chain": 8, "after_required_fields": 6, "after_wildcards": 5,
        "after_confidence_filter": 3, "after_gene_standardization": 2, "after_dedup": 1,
    }


def test_vdjdb_without_score_and_other_chain(spark):
    raw = vdjdb(spark, {"gene": "TRA"}).drop("vdjdb.score")
    assert cl.clean_rows(cl.mark_vdjdb(raw, chain="TRA"), "VDJdb").first()["tcr_chain"] == "TRA"


def test_missing_column(spark):
    with pytest.raises(ValueError, match="mhc.b"):
        cl.mark_vdjdb(vdjdb(spark).drop("mhc.b"))


IEDB = {
    "Chain 2|CDR3 Curated": "", "Chain 2|CDR3 Calculated": "CASSF", "Chain 2|Curated V Gene": "TRBV1*01",
    "Chain 2|Calculated V Gene": None, "Chain 2|Curated J Gene": "TRBJ1*01", "Chain 2|Calculated J Gene": None,
    "Chain 2|Type": "beta", "Chain 2|Organism IRI": "http://x/NCBITaxon_9606", "Epitope|Name": "GIL",
    "Epitope|IEDB IRI": "https://e/1", "Reference|IEDB IRI": "http://r/1", "Assay|MHC Allele Names": "HLA-A*02:01",
}


def iedb(spark, *changes):
    rows = [tuple({**IEDB, **c}.values()) for c in ({}, *changes)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in IEDB))


def assays(spark):
    rows = [("http://e/1 ", "https://r/1", "ELISPOT"), ("http://e/1", "http://r/1", "multimer/tetramer"), ("http://e/2", "http://r/1", None)]
    return spark.createDataFrame(rows, "`Epitope|IEDB IRI` string, `Reference|IEDB IRI` string, `Assay|Method` string")


def test_iedb(spark, ref):
    raw = iedb(
        spark, {"Chain 2|Type": "alpha"}, {"Chain 2|Organism IRI": None}, {"Epitope|IEDB IRI": "http://e/2"},
        {"Assay|MHC Allele Names": "HLA class II"}, {"Chain 2|CDR3 Curated": "CAQ"}, {"Chain 2|Organism IRI": "NCBITaxon_96061"},
    )
    marked = cl.mark_iedb(raw, assays(spark), ref)
    assert steps(cl.funnel(marked, "IEDB")) == {
        "loaded_rows": 7, "after_species": 6, "after_chain": 5, "after_confidence_filter": 4, "after_required_fields": 3,
        "after_wildcards": 3, "after_gene_standardization": 3, "after_dedup": 2,
    }
    assert {r["cdr3"] for r in cl.clean_rows(marked, "IEDB").collect()} == {"CASSF", "CAQ"}
    strict = cl.mark_iedb(raw, assays(spark), ref, strict_class_names=True)
    assert {r["mhc_class"] for r in cl.clean_rows(strict, "IEDB").collect()} == {"MHCI", "MHCII"}


def test_iedb_without_assays_skips_the_step(spark, ref):
    found = steps(cl.funnel(cl.mark_iedb(iedb(spark), None, ref), "IEDB"))
    assert "after_confidence_filter" not in found and found["after_dedup"] == 1


def test_other_sources_are_beta_only(spark):
    with pytest.raises(ValueError):
        cl.mark_iedb(iedb(spark), chain="TRA")


def test_assay_methods(spark):
    got = {(r["epi"], r["ref"]): r["methods"] for r in cl.assay_methods(assays(spark)).collect()}
    assert got == {("http://e/1", "http://r/1"): ["ELISPOT", "multimer/tetramer"], ("http://e/2", "http://r/1"): []}


def test_mcpas_and_pooling(spark, ref):
    rows = [("CASSF", "TRBV1*01", "TRBJ1*01", "GIL", "HLA-A2", "Human "), (None, "TRBV1*01", "TRBJ1*01", "GIL", "HLA-A2", "Human"),
            ("CASSG", "TRBV1*01", "TRBJ1*01", "G?L", "HLA-A2", "Human"), ("CASSG", "TRBV1*01", "TRBJ1*01", "GIL", "HLA-A2", "Mouse")]
    raw = spark.createDataFrame(rows, "`CDR3.beta.aa` string, TRBV string, TRBJ string, `Epitope.peptide` string, MHC string, Species string")
    marked = cl.mark_mcpas(raw, ref)
    assert list(steps(cl.funnel(marked, "McPAS")).values()) == [4, 3, 2, 1, 1, 1]
    pairs, funnel = cl.build_pairs({"McPAS": marked, "VDJdb": cl.mark_vdjdb(vdjdb(spark), ref)})
    assert pairs.count() == 2 and funnel.count() == 14
    assert funnel.filter("n_removed < 0").isEmpty()


def test_promiscuous(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), ("c", "q")], "cdr3 string, peptide string")
    assert sorted(r["cdr3"] for r in cl.drop_promiscuous(df).collect()) == ["a", "a", "c"]
    assert tuple(cl.promiscuous_count(df).first()) == (2, 1)


def test_paired_tables(spark):
    df = spark.createDataFrame([("CA-S", "cb.s", "pep", "V", None), (None, None, "pep", None, "H")], "CDR3a string, CDR3b string, Peptide string, Vb string, HLA string")
    norm = cl.normalise_paired(df)
    assert [tuple(r) for r in norm.collect()] == [("CAS", "CBS", "PEP", "V", None), ("", "", "PEP", None, "H")]
    single = cl.paired_to_single(norm).first()
    assert (single["cdr3"], single["v_gene"], single["j_gene"], single["mhc_a"], single["mhc_class"]) == ("CBS", "V", "", "", "MHCI")
    assert [r["cdr3"] for r in cl.attach_paired_cdr3(norm).collect()] == ["CASCBS"]
    assert cl.keep_peptides(norm, ["PEP"]).count() == 2 and cl.keep_peptides(norm).count() == 0


def test_null_counts(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    assert tuple(cl.null_counts(df, ["x", "y"]).first()) == (2, 1, 1)
    assert cl.drop_nulls(df, ["y"]).count() == 1
    assert cl.keep_existing(df, ["y", "z", "x"]).columns == ["y", "x"]


def test_stitch(spark):
    v = spark.createDataFrame([("V1", "QV", "M", "CAS"), ("V2", "RV", None, "CAS")], "v_gene string, body string, leader string, anchor string")
    j = spark.createDataFrame([("J1", "GG", "F"), ("J2", "G*", "F")], "j_gene string, body string, terminal string")
    rows = [("CASSF", "V1", "J1"), ("ASSF", "V1", "J1"), ("CASS", "V1", "J1"), ("CATF", "V1", "J1"), ("AT", "V1", "J1"),
            ("CASSF", "V2", "J1"), ("CASSF", "V1", "J2"), ("CASSF", "V9", "J1")]
    df = spark.createDataFrame(rows, "cdr3 string, v_gene string, j_gene string")
    got = {tuple(r)[:3]: r["full_aa"] for r in st.stitch_full_sequence(df, v, j, "E", leader=True).collect()}
    assert [got[r] for r in rows] == ["MQVCASSFGGE", "MQVCASSFGGE", "MQVCASSFGGE", "MQVCATFGGE", "MQVCATFGGE", "RVCASSFGGE", None, None]
    full = st.stitch_full_sequence(df, v, j, "E")
    report = st.stitch_report(full).first()
    assert tuple(report) == (8, 2, 25.0, 0, 6)
    table = st.full_sequence_table(full.withColumn("peptide", F.lit("P")))
    assert table.columns == ["full_aa", "cdr3_start", "cdr3_end", "peptide", "cdr3", "v_gene", "j_gene"]
    assert all(r["cdr3"] in r["full_aa"][r["cdr3_start"]:r["cdr3_end"]] for r in table.collect())
    with pytest.raises(RuntimeError):
        st.check_not_empty(full.filter("v_gene = 'V9'"))


def test_stitch_finds_j_genes_with_and_without_allele(spark):
    v = spark.createDataFrame([("V1", "Q", None, "CAS")], "v_gene string, body string, leader string, anchor string")
    j = spark.createDataFrame(
        [("J1", "A", "F"), ("J1*01", "C", "F"), ("J2*01", "D", "F"), ("J2*02", "E", "F"), ("J3*02", "G", "F"), (None, "K", "F")],
        "j_gene string, body string, terminal string",
    )
    genes = ["J1", "J1*01", "J2", "J2*01", "J2*02", "J3", "J3*02", None]
    df = spark.createDataFrame([("CASSF", "V1", g) for g in genes], "cdr3 string, v_gene string, j_gene string")
    got = {r["j_gene"]: r["full_aa"] for r in st.stitch_full_sequence(df, v, j).collect()}
    assert [got[g] and got[g][-1] for g in genes] == ["A", "C", "D", "D", "E", None, "G", None]


def test_gene_tables_are_written_before_pairs_meet_them(spark):
    from bindery.operators.stitch import stitch_full_sequence

    pairs = spark.createDataFrame([("CAF", "V1", "J1*01"), ("CAF", None, "J1")], "cdr3 string, v_gene string, j_gene string")
    v = spark.createDataFrame([("V1", "MV", "L", "C")], "v_gene string, body string, leader string, anchor string")
    j = spark.createDataFrame([("J1*01", "GG", None)], "j_gene string, body string, terminal string")
    full = stitch_full_sequence(pairs, v, j)
    assert len(full.inputFiles()) >= 2
    assert sorted((r["v_gene"] or "", r["full_aa"]) for r in full.collect()) == [("", None), ("V1", "MVCAFGG")]
