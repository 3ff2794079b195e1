"""Queries on reports and ledgers, and their SQL.

The ledgers are derived from the line items: one experiment per brand, type and model
family, with settings and scores computed from its rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bindery.operators import metrics as mt
from bindery.operators import report as rp
from catalog.metrics import _FINE, _PER, curve_sql, metric_sql
from catalog.metrics import fine
from catalog.views import table, view, with_views

_NAMES = (
    "CASE p_partkey % 9 WHEN 0 THEN 'one_hot' WHEN 1 THEN 'onehot_meta' WHEN 2 THEN 'vae_aug-cat_ae' "
    "WHEN 3 THEN 'ESM_cdr3' WHEN 4 THEN 'cross_attention_esm-full' WHEN 5 THEN 'raw_aug' WHEN 6 THEN 'ae_meta' "
    "WHEN 7 THEN 'gnn' ELSE 'other' END"
)
LEDGER = f"""
SELECT model, {_NAMES} || '_' || p_brand AS experiment_name,
       CASE WHEN p_partkey % 4 = 0 THEN 'cat_ae' WHEN p_partkey % 4 = 1 THEN 'none' END AS metadata,
       count(*) AS n_test,
       round(avg(l_discount) * 10, 6) AS auroc, round(max(l_extendedprice) / 110000, 6) AS auprc, round(avg(l_tax) * 10, 6) AS f1
FROM (SELECT l.*, p.p_partkey, p.p_brand, CASE l_linenumber WHEN 1 THEN 'cnn' WHEN 2 THEN 'cross_attention' WHEN 3 THEN 'gnn'
        WHEN 4 THEN 'mlp' ELSE 'random_forest' END AS model
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) x
GROUP BY 1, 2, 3
"""


def ledger(spark, folder):
    for name in ("lineitem", "part"):
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(LEDGER)


def family(spark, folder, model):
    one = ledger(spark, folder).filter(F.col("model") == model)
    return one.groupBy("experiment_name").agg(F.max("auprc").alias("auprc"), F.sum("n_test").alias("n_test"))


def q_dataset_summary(spark, folder):
    return rp.dataset_summary(view(spark, folder, "positives"))


def q_value_counts_top(spark, folder):
    return rp.top_values(view(spark, folder, "positives"), ["source", "mhc_a", "v_gene", "j_gene"])


def q_length_histogram(spark, folder):
    hist = rp.length_histogram(view(spark, folder, "positives"), {"peptide": 20, "cdr3": 25})
    return hist.withColumn("left_edge", F.round("left_edge", 6))


def q_labelled_results(spark, folder):
    return rp.labelled_results(ledger(spark, folder)).select("model", "experiment_name", "metadata", "representation", "meta", "model_name")


def q_result_pivot(spark, folder):
    return rp.result_pivot(rp.labelled_results(ledger(spark, folder)), "auroc")


def q_best_per_group(spark, folder):
    return rp.best_per_representation(rp.labelled_results(ledger(spark, folder)))


def q_metadata_ablation(spark, folder):
    return rp.metadata_ablation(rp.labelled_results(ledger(spark, folder)))


def q_experiment_names(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey",
        F.expr("CASE p_partkey % 5 WHEN 0 THEN ' plain_ae ' WHEN 1 THEN 'vae' WHEN 2 THEN 'esm_full' WHEN 3 THEN 'esm\\\\cdr3' ELSE 'one_hot' END").alias("emb"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'one_hot' WHEN 1 THEN 'cat_ae' END").alias("cat"),
    )
    return rows.select(
        "p_partkey", rp.canonical_embedding(F.col("emb")).alias("embedding"),
        rp.experiment_name(F.col("emb"), F.col("cat")).alias("experiment_name"),
    )


def q_ledger_upsert(spark, folder):
    old = family(spark, folder, "cnn").withColumn("n_params", F.length("experiment_name"))
    new = family(spark, folder, "gnn").filter(F.col("n_test") % 2 == 0).withColumn("threshold", F.col("auprc") / 2)
    return rp.upsert(old, new)


def q_missing_runs(spark, folder):
    grid = family(spark, folder, "cnn").select("experiment_name", F.split("experiment_name", "_")[0].alias("receptor_embedding"))
    return rp.missing_runs(grid, family(spark, folder, "gnn").filter(F.col("n_test") % 2 == 0), only=["onehot", "gnn", "ae"])


def q_merge_ledgers(spark, folder):
    return rp.merge_ledgers({
        "cnn": family(spark, folder, "cnn").withColumn("n_params", F.length("experiment_name")),
        "mlp": family(spark, folder, "mlp").withColumn("threshold", F.lit(0.25)),
    })


def model_scores(spark, folder):
    """Two models' per-peptide results: the stored score and one minus it."""
    rows = fine(spark, folder)
    one = mt.per_peptide_metrics(rows).select(F.lit("by value").alias("model"), "peptide", F.round("auc01", 9).alias("auc01"))
    two = mt.per_peptide_metrics(rows.withColumn("score", -F.col("score")))
    return one.unionByName(two.select(F.lit("reversed").alias("model"), "peptide", F.round("auc01", 9).alias("auc01")))


def q_leaderboard(spark, folder):
    board = rp.leaderboard(model_scores(spark, folder))
    return board.withColumn("macro_auc01", F.round("macro_auc01", 8))


def q_model_by_peptide(spark, folder):
    return rp.model_by_peptide(model_scores(spark, folder), ["by value", "reversed"])


def q_model_peptide_rows(spark, folder):
    return model_scores(spark, folder)


QUERIES = {
    "dataset_summary": q_dataset_summary,
    "value_counts_top": q_value_counts_top,
    "length_histogram": q_length_histogram,
    "labelled_results": q_labelled_results,
    "result_pivot": q_result_pivot,
    "best_per_group": q_best_per_group,
    "metadata_ablation": q_metadata_ablation,
    "experiment_names": q_experiment_names,
    "ledger_upsert": q_ledger_upsert,
    "missing_runs": q_missing_runs,
    "merge_ledgers": q_merge_ledgers,
    "leaderboard": q_leaderboard,
    "model_by_peptide": q_model_by_peptide,
    "model_peptide_rows": q_model_peptide_rows,
}

_REP = """CASE WHEN contains(n, 'esm_cdr3') OR contains(n, 'esm-cdr3') THEN 'ESM (CDR3)'
  WHEN contains(n, 'esm_full') OR contains(n, 'esm-full') THEN 'ESM (Full VDJ)' WHEN contains(n, 'vae') THEN 'VAE'
  WHEN contains(n, 'one_hot') OR contains(n, 'onehot') THEN 'One-hot' WHEN contains(n, 'raw') THEN 'Raw Sequence'
  WHEN contains(n, 'gnn') THEN 'Graph' WHEN contains(n, 'autoencoder') OR list_contains(string_split(n, '_'), 'ae') THEN 'AE'
  ELSE 'Unknown' END"""
_LAB = f"""ledger AS ({LEDGER}),
  lab AS (SELECT *, {_REP} AS representation,
    CASE WHEN contains(coalesce(metadata, ''), 'cat_ae') OR contains(coalesce(metadata, ''), 'one_hot') OR contains(experiment_name, 'meta')
         THEN '+' ELSE '–' END AS meta,
    CASE model WHEN 'cnn' THEN 'CNN' WHEN 'cross_attention' THEN 'CA' WHEN 'gnn' THEN 'GNN' WHEN 'mlp' THEN 'MLP'
         WHEN 'random_forest' THEN 'RF' ELSE model END AS model_name
    FROM (SELECT *, lower(experiment_name) AS n FROM ledger))"""
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY representation
    ORDER BY auprc DESC, model_name, experiment_name) AS q FROM lab WHERE model_name <> 'RF' AND representation <> 'Unknown') WHERE q = 1)"""
_REPS = ["One-hot", "AE", "VAE", "ESM (CDR3)", "ESM (Full VDJ)", "Raw Sequence", "Graph"]
_CELLS = ", ".join(
    f"""max(auroc) FILTER (WHERE representation = '{r}' AND meta = '{m}') AS "{r} {m}" """ for r in _REPS for m in ("–", "+")
)


def _family(model, name):
    return f"{name} AS (SELECT experiment_name, max(auprc) AS auprc, sum(n_test)::BIGINT AS n_test FROM ledger WHERE model = '{model}' GROUP BY 1)"


def _summary_part(c):
    return f"SELECT 'unique {c}' AS quantity, count(DISTINCT {c}) AS value FROM positives"


def _top_part(c):
    return f"SELECT '{c}' AS col, {c} AS value, count(*) AS n_rows FROM positives GROUP BY {c}"


def _hist_part(c, bins):
    return f"""SELECT '{c}' AS col, bin, round(lo + bin * width, 6) AS left_edge, count(*) AS n_rows FROM (
        SELECT *, least(floor((x - lo) / width), {bins} - 1)::INT AS bin FROM (
          SELECT length({c}) AS x, lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END::DOUBLE AS width
          FROM positives, (SELECT min(length({c})) AS lo, max(length({c})) AS hi FROM positives))) GROUP BY bin, lo, width"""


_TWO = f"""{_FINE}, {curve_sql('fine')}, {metric_sql()}, {_PER},
    back AS (SELECT peptide, label, -score AS score FROM fine), {curve_sql('back', name='c2')},
    {metric_sql(curve='c2').replace('pieces', 'p2').replace('areas', 'a2').replace('summed', 's2')},
    {_PER.replace('per AS', 'per2 AS').replace('summed', 's2')},
    runs AS (SELECT 'by value' AS model, peptide, auc01 FROM per UNION ALL SELECT 'reversed', peptide, auc01 FROM per2)"""

ORACLE = {
    "dataset_summary": with_views(
        " UNION ALL ".join(
            ["SELECT 'rows' AS quantity, count(*) AS value FROM positives"]
            + [_summary_part(c) for c in ("cdr3", "peptide", "v_gene", "j_gene", "mhc_a")]
            + ["SELECT 'rows from ' || source, count(*) FROM positives GROUP BY source"]
        ),
        "positives",
    ),
    "value_counts_top": with_views(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n_rows DESC, value) AS place FROM (
            {' UNION ALL '.join(_top_part(c) for c in ('source', 'mhc_a', 'v_gene', 'j_gene'))})) WHERE place <= 20""",
        "positives",
    ),
    "length_histogram": with_views(f"{_hist_part('peptide', 20)} UNION ALL {_hist_part('cdr3', 25)}", "positives"),
    "labelled_results": f"WITH {_LAB} SELECT model, experiment_name, metadata, representation, meta, model_name FROM lab",
    "result_pivot": f"""WITH {_LAB}, m AS (SELECT unnest(['RF', 'MLP', 'CNN', 'CA', 'GNN']) AS model_name)
        SELECT model_name, {_CELLS} FROM m LEFT JOIN lab USING (model_name) GROUP BY model_name""",
    "best_per_group": f"WITH {_LAB}, {_BEST} SELECT representation, model_name, experiment_name, meta, auprc FROM best",
    "metadata_ablation": f"""WITH {_LAB}, {_BEST} SELECT l.representation, b.model_name AS best_model,
        max(l.auprc) FILTER (WHERE l.meta = '+') AS with_meta, max(l.auprc) FILTER (WHERE l.meta = '–') AS without_meta
        FROM lab l JOIN best b ON b.representation = l.representation AND b.model_name = l.model_name GROUP BY 1, 2""",
    "experiment_names": """SELECT p_partkey,
        CASE p_partkey % 5 WHEN 0 THEN 'autoencoder/plain_ae' WHEN 1 THEN 'autoencoder/vae' WHEN 2 THEN 'esm/full'
             WHEN 3 THEN 'esm/cdr3' ELSE 'one_hot' END AS embedding,
        CASE p_partkey % 5 WHEN 0 THEN 'ae' WHEN 1 THEN 'vae' WHEN 2 THEN 'esm_vdj' WHEN 3 THEN 'esm_cdr3' ELSE 'onehot' END
          || CASE WHEN p_partkey % 3 < 2 THEN '_meta' ELSE '' END AS experiment_name FROM part""",
    "ledger_upsert": f"""WITH ledger AS ({LEDGER}), {_family('cnn', 'a')}, {_family('gnn', 'g')},
        b AS (SELECT *, auprc / 2 AS threshold FROM g WHERE n_test % 2 = 0)
        SELECT experiment_name, auprc, n_test, threshold, NULL::INT AS n_params FROM b
        UNION ALL SELECT experiment_name, auprc, n_test, NULL, length(experiment_name) FROM a
        WHERE experiment_name NOT IN (SELECT experiment_name FROM b)""",
    "missing_runs": f"""WITH ledger AS ({LEDGER}), {_family('cnn', 'a')}, {_family('gnn', 'g')}
        SELECT experiment_name, string_split(experiment_name, '_')[1] AS receptor_embedding FROM a
        WHERE string_split(experiment_name, '_')[1] IN ('onehot', 'gnn', 'ae')
          AND experiment_name NOT IN (SELECT experiment_name FROM g WHERE n_test % 2 = 0)""",
    "merge_ledgers": f"""WITH ledger AS ({LEDGER}), {_family('cnn', 'a')}, {_family('mlp', 'm')}
        SELECT experiment_name, auprc, n_test, length(experiment_name) AS n_params, 'cnn' AS model, NULL::DOUBLE AS threshold FROM a
        UNION ALL SELECT experiment_name, auprc, n_test, NULL, 'mlp', 0.25 FROM m""",
    "leaderboard": f"WITH {_TWO} SELECT model, round(avg(auc01), 8) AS macro_auc01 FROM runs GROUP BY model",
    "model_by_peptide": f"""WITH {_TWO} SELECT peptide, max(auc01) FILTER (WHERE model = 'by value') AS "by value",
        max(auc01) FILTER (WHERE model = 'reversed') AS reversed FROM runs GROUP BY peptide""",
    "model_peptide_rows": f"WITH {_TWO} SELECT * FROM runs",
}
