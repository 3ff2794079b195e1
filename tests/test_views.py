"""What Spark gets for a view has the rows of the view's SQL, without its wide shuffle."""

from catalog import views


def test_paired_rows_are_those_of_its_sql(spark):
    columns = "cdr3 string, v_gene string, j_gene string, peptide string, mhc_a string, source string"
    rows = [
        ("CASSAF", "TRBV1*01", "TRBJ1-1*01", "GIL", "A", "IEDB"),
        ("CASSAF", "TRBV1*01", "TRBJ1-1*01", "gil", "A", "McPAS"),  # one row with the first, in lower case
        ("CASSA", "TRBV1*01", "TRBJ1-1*01", "GIL", "A", "IEDB"),
        ("CASSA.", "TRBV2*01", "TRBJ1-1*01", "GIL", None, "IEDB"),
        (None, None, None, None, None, None), (None, None, None, None, None, "VDJdb"),
        ("", "", "", "", "", ""), ("CASSAF", None, "TRBJ1-1*01", "GIL", "A", "IEDB"),
    ]
    pairs = spark.createDataFrame(rows, columns)
    got = views.view(spark, "", "paired", pairs).collect()
    want = spark.sql(views.PAIRED.replace("FROM positives", "FROM {positives}"), positives=pairs).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6


def test_paired_columns_nobody_asks_for_are_not_made(spark, folder):
    few = views.view(spark, folder, "paired").select("cdr3b", "peptide")
    assert "cdr1a" not in few._jdf.queryExecution().optimizedPlan().toString()
