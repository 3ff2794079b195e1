"""Queries that write a derived table to files and read it back with the library."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from bindery.constants import RESIDUES
from bindery.functions.text import residue_ids
from bindery.sources import files as fl
from bindery.staging import shared_folder
from catalog.clean import _IEDB, iedb, mcpas, vdjdb
from catalog.views import table, view, with_views


def scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_read_vdjdb(spark, folder):
    path = scratch(spark, "vdjdb.csv")
    fl.write_csv(vdjdb(spark, folder), path)
    back = fl.read_vdjdb(spark, path, multi_line=False)
    return back.toDF(*[c.replace(".", "_") for c in back.columns])


def q_read_two_row_header(spark, folder):
    """The export as text files that each begin with the two header rows, compressed as its rows
    say much the same over and over."""
    rows = iedb(spark, folder)
    upper, lower = zip(*[c.split("|") for c in rows.columns])
    head = [",".join(upper), ",".join(lower)]

    def with_head(frames):
        yield pd.DataFrame({"line": head})
        yield from frames

    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    lines = rows.select(F.to_csv(cells, keep).alias("line"))
    path = scratch(spark, "iedb.csv")
    lines.mapInPandas(with_head, "line string").write.text(path, compression="gzip")
    back = fl.read_two_row_header(spark, path, multi_line=False)
    return back.toDF(*_IEDB)


def q_read_mcpas(spark, folder):
    path = scratch(spark, "mcpas.csv")
    rows = mcpas(spark, folder).withColumn("Species", F.when(F.col("Species") == "Mouse", "NA").otherwise(F.col("Species")))
    fl.write_csv(rows, path)
    back = fl.read_mcpas(spark, path, multi_line=False)
    return back.toDF(*[c.replace(".", "_").lower() for c in back.columns])


def q_tsv_to_csv(spark, folder):
    root = scratch(spark, "tsv")
    paths = []
    for name in ("customer", "orders", "part"):
        path = f"{root}/{name}.txt"
        table(spark, folder, name).write.options(header=True, sep="\t").csv(path)
        paths.append(path)
    return fl.tsv_to_csv(spark, [*paths, f"{root}/LICENSE.txt"], scratch(spark, "csv"))


def q_vector_store(spark, folder):
    path = scratch(spark, "vectors")
    rows = view(spark, folder, "positives").select("cdr3").distinct()
    fl.write_vectors(rows.select("cdr3", residue_ids("cdr3", 20).alias("vec")), path)
    back = fl.read_vectors(spark, path, ["cdr3"])
    return back.select("cdr3", F.aggregate("vec", F.lit(0), lambda a, x: a + x).alias("total"), F.size("vec").alias("dim"))


def q_read_paired_train(spark, folder):
    path = scratch(spark, "paired.csv")
    rows = view(spark, folder, "paired").select(
        F.col("peptide").alias("Peptide"), F.col("hla").alias("HLA"), F.col("va").alias("Va"), F.col("cdr3a").alias("CDR3a"),
        F.col("cdr3b").alias("CDR3b"), (F.length("cdr3b") % 3 > 0).cast("int").alias("Target"),
    )
    fl.write_csv(rows, path)
    return fl.read_paired_train(spark, path)[0]


def q_read_paired_test(spark, folder):
    left, right = scratch(spark, "test.csv"), scratch(spark, "solutions.csv")
    rows = table(spark, folder, "customer")
    fl.write_csv(rows.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Peptide"), F.col("c_mktsegment").alias("HLA")), left)
    answers = rows.select(F.col("c_custkey").alias("ID"), (F.col("c_acctbal") > 5000).cast("int").alias("Label"), F.lit("Public").alias("Usage"))
    unmatched = rows.select((-1 - F.col("c_custkey")).alias("ID"), F.lit(1).alias("Label"), F.lit("Private").alias("Usage"))
    fl.write_csv(answers.unionByName(unmatched), right)
    return fl.read_paired_test(spark, left, right)


QUERIES = {
    "read_vdjdb": q_read_vdjdb,
    "read_two_row_header": q_read_two_row_header,
    "read_mcpas": q_read_mcpas,
    "tsv_to_csv": q_tsv_to_csv,
    "vector_store": q_vector_store,
    "read_paired_train": q_read_paired_train,
    "read_paired_test": q_read_paired_test,
}
ORACLE = {
    "read_vdjdb": with_views(
        f"""SELECT {', '.join(f"nullif({c}, '') AS {c}" for c in ('gene', 'cdr3', 'v_segm', 'j_segm', 'species', 'mhc_a', 'mhc_b', 'mhc_class', 'antigen_epitope'))},
                   score AS vdjdb_score FROM raw_vdjdb""",
        "raw_vdjdb",
    ),
    "read_two_row_header": with_views(
        f"SELECT {', '.join(f'CASE WHEN {c} <> {chr(39)*2} THEN {c} END AS {c}' for c in _IEDB)} FROM raw_iedb", "raw_iedb"
    ),
    "read_mcpas": with_views(
        """SELECT cdr3_beta AS cdr3_beta_aa, trbv, trbj, epitope_peptide, mhc, CASE WHEN species <> 'Mouse' THEN species END AS species
           FROM raw_mcpas""",
        "raw_mcpas",
    ),
    "tsv_to_csv": """SELECT 'customer.txt' AS name, count(*) AS n_rows FROM customer
        UNION ALL SELECT 'orders.txt', count(*) FROM orders UNION ALL SELECT 'part.txt', count(*) FROM part""",
    "vector_store": with_views(
        f"""SELECT cdr3, list_sum(list_transform(range(1, length(cdr3) + 1), lambda i: instr('-{RESIDUES}', substr(cdr3, i, 1)) - 1))::BIGINT AS total, 20 AS dim
            FROM (SELECT DISTINCT cdr3 FROM positives)""",
        "positives",
    ),
    "read_paired_train": with_views(
        """SELECT upper(peptide) AS peptide, hla, va, replace(cdr3a, '-', '') AS cdr3a, replace(cdr3b, '.', '') AS cdr3b,
                  (length(cdr3b) % 3 > 0)::INT AS label FROM paired""",
        "paired",
    ),
    "read_paired_test": """SELECT c_custkey::VARCHAR AS id, upper(replace(replace(c_name, '-', ''), '.', '')) AS peptide, c_mktsegment AS hla,
        (c_acctbal > 5000)::INT AS label, 'Public' AS usage FROM customer""",
}
