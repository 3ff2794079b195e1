"""Queries on splits and samples and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindery.operators import split as sp
from catalog.negatives import ALL
from catalog.views import stored, table, view, with_views


def q_split_by_peptide(spark, folder):
    return sp.holdout(stored(spark, folder, "positives"), "peptide")


def q_split_by_receptor(spark, folder):
    return sp.holdout(stored(spark, folder, "positives"), "cdr3", 0.15, 0.1, seed=7)


def q_split_random(spark, folder):
    return sp.random_split(stored(spark, folder, "positives"))


def q_split_stats(spark, folder):
    return sp.split_stats(sp.holdout(stored(spark, folder, "positives"), "peptide"))


def q_assign_by_key(spark, folder):
    pairs = view(spark, folder, "positives")
    keys = pairs.groupBy("peptide").agg(F.count("*").alias("n"))
    keys = keys.filter(F.col("n") != 12).withColumn("split", F.when(F.col("n") > 12, "train").otherwise("test"))
    return sp.assign_by_key(pairs.select("cdr3", "peptide", "source"), keys, "peptide")


def q_stratified_val(spark, folder):
    return sp.stratified_val(view(spark, folder, "positives"))


def q_stratified_folds(spark, folder):
    return sp.stratified_folds(table(spark, folder, "embeddings").select("vec_id", "label"), "label", 5, ["vec_id"])


def q_balanced_subset(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("cls")
    )
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sp.balanced_subset(rows.distinct(), "cls", 6, 100, key)


def q_stratified_sample(spark, folder):
    rows = table(spark, folder, "embeddings")
    rows = rows.withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    return sp.stratified_sample(rows, 200, "label", "embedding", ["vec_id"]).select("vec_id", "label")


def q_plain_sample(spark, folder):
    rows = table(spark, folder, "embeddings")
    return sp.stratified_sample(rows, 150, "label", "embedding", ["vec_id"], stratify=False).select("vec_id", "label")


def q_sample_rows(spark, folder):
    return sp.sample_rows(view(spark, folder, "positives"), 100, ALL.split(", "))


def q_first_rows(spark, folder):
    return sp.first_rows(table(spark, folder, "customer").select("c_custkey", "c_name"), 50, ["c_custkey"])


QUERIES = {
    "split_by_peptide": q_split_by_peptide,
    "split_by_receptor": q_split_by_receptor,
    "split_random": q_split_random,
    "split_stats": q_split_stats,
    "assign_by_key": q_assign_by_key,
    "stratified_val": q_stratified_val,
    "stratified_folds": q_stratified_folds,
    "balanced_subset": q_balanced_subset,
    "stratified_sample": q_stratified_sample,
    "plain_sample": q_plain_sample,
    "sample_rows": q_sample_rows,
    "first_rows": q_first_rows,
}


def holdout_sql(key, test, val, seed):
    return f"""WITH keys AS (SELECT {key}, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {key})), {key}) AS r,
                  count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM positives)),
         cuts AS (SELECT *, greatest(1, round_even(n * {test}::DOUBLE, 0)) AS t,
                            greatest(1, round_even(n * {val}::DOUBLE, 0)) AS v FROM keys),
         placed AS (SELECT positives.*, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split
                    FROM positives JOIN cuts USING ({key}))"""


ORACLE = {
    "split_by_peptide": with_views(f"{holdout_sql('peptide', 0.2, 0.1, 42)} SELECT * FROM placed", "positives"),
    "split_by_receptor": with_views(f"{holdout_sql('cdr3', 0.15, 0.1, 7)} SELECT * FROM placed", "positives"),
    "split_random": with_views(
        f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', {ALL})), {ALL}) AS q,
                       count(*) OVER () AS n FROM positives),
              s AS (SELECT *, ceil(n * 0.2::DOUBLE) AS t FROM r)
            SELECT {ALL}, CASE WHEN q <= t THEN 'test'
                WHEN q <= t + ceil((n - t) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) THEN 'val' ELSE 'train' END AS split
            FROM s""",
        "positives",
    ),
    "split_stats": with_views(
        f"""{holdout_sql('peptide', 0.2, 0.1, 42)} SELECT split, count(*) AS n_rows,
            count(DISTINCT peptide) AS n_peptides, count(DISTINCT cdr3) AS n_cdr3s FROM placed GROUP BY split""",
        "positives",
    ),
    "assign_by_key": with_views(
        """SELECT p.cdr3, p.peptide, p.source, CASE WHEN n > 12 THEN 'train' ELSE 'test' END AS split
           FROM positives p JOIN (SELECT peptide, count(*) AS n FROM positives GROUP BY peptide) k USING (peptide)
           WHERE n <> 12""",
        "positives",
    ),
    "stratified_val": with_views(
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY md5(concat_ws('|', '42', {ALL})), {ALL}) AS q,
                       count(*) OVER (PARTITION BY peptide) AS n FROM positives),
              s AS (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS v FROM r)
            SELECT {ALL}, CASE WHEN q <= (CASE WHEN v >= n THEN greatest(1, n - 1) ELSE v END) THEN 'val'
                               ELSE 'train' END AS split FROM s""",
        "positives",
    ),
    "stratified_folds": """SELECT vec_id, label, cast((row_number() OVER (PARTITION BY label
        ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) - 1) % 5 AS int) AS fold FROM embeddings""",
    "balanced_subset": """WITH d AS (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey,
            cast(l_quantity AS int) AS cls FROM lineitem),
        top AS (SELECT cls FROM (SELECT cls, count(*) AS n FROM d GROUP BY cls) ORDER BY n DESC, cls LIMIT 6)
        SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls
          ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                   l_orderkey, l_linenumber, l_partkey, l_suppkey) AS q FROM d WHERE cls IN (SELECT cls FROM top)) WHERE q <= 100""",
    "stratified_sample": """WITH w AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 9 <> 0)
        SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS q FROM w)
        WHERE q <= (SELECT greatest(1, 200 // count(DISTINCT label)) FROM w)""",
    "plain_sample": """SELECT vec_id, label FROM (SELECT *, row_number() OVER (
        ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS q FROM embeddings) WHERE q <= 150""",
    "sample_rows": with_views(
        f"""SELECT {ALL} FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', {ALL})), {ALL}) AS q
            FROM positives) WHERE q <= 100""",
        "positives",
    ),
    "first_rows": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50",
}
