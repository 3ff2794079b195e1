"""Queries on metrics and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindery.operators import metrics as mt
from bindery.operators import split as sp
from bindery.operators.order import every_nth, ordered_rank
from bindery.plans.experiments import save_run
from bindery.staging import shared_folder
from catalog.views import table, view, with_views

D = 9  # digits kept of every floating result


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, D) for c in cols})


def scored(spark, folder):
    return view(spark, folder, "scored")


def fine(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select(
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("peptide"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value").alias("score"),
    )


def q_score_curve(spark, folder):
    return mt.score_curve(scored(spark, folder), ["peptide"])


def q_auroc(spark, folder):
    curve = mt.score_curve(scored(spark, folder), ["peptide"])
    return rounded(mt.rank_metrics(curve, ["peptide"]).select("peptide", "auroc"), "auroc")


def q_auprc(spark, folder):
    curve = mt.score_curve(scored(spark, folder), ["peptide"])
    return rounded(mt.rank_metrics(curve, ["peptide"]).select("peptide", "auprc"), "auprc")


def q_partial_auc(spark, folder):
    curve = mt.score_curve(scored(spark, folder), ["peptide"])
    return rounded(mt.rank_metrics(curve, ["peptide"]).select("peptide", "auc01"), "auc01")


def q_overall_metrics(spark, folder):
    rows = scored(spark, folder).withColumn("score", F.col("fine_score"))
    return rounded(mt.overall_metrics(rows), "auroc", "auprc", "auc01")


def q_per_peptide(spark, folder):
    return rounded(mt.per_peptide_metrics(fine(spark, folder)), "auc01", "auroc", "auprc")


def q_saved_metrics(spark, folder):
    """The metrics by peptide that a run saves, read back from its folder."""
    path = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    rows = fine(spark, folder)
    save_run(path, mt.overall_metrics(rows).first().asDict(), rows)
    kinds = mt.per_peptide_metrics(rows).schema
    back = spark.read.csv(f"{path}/per_peptide", header=True, schema=kinds)
    return rounded(back, "auc01", "auroc", "auprc")


def q_macro_auc(spark, folder):
    return rounded(mt.macro_auc01(mt.per_peptide_metrics(fine(spark, folder))), "macro_auc01")


def q_best_f1_threshold(spark, folder):
    curve = mt.score_curve(scored(spark, folder), ["peptide"])
    return rounded(mt.best_f1_threshold(curve, ["peptide"]), "threshold", "best_f1")


def q_confusion_at(spark, folder):
    return rounded(mt.metrics_at(scored(spark, folder), 0.5, ["peptide"]), "accuracy", "f1")


def q_threshold_report(spark, folder):
    rows = scored(spark, folder)
    part = lambda c: rows.filter(c)
    is_test = F.col("peptide") == "G0"
    is_val = F.col("peptide") == "G1"
    rules = {"val_optimal": part(is_val), "train_optimal": part(~is_test & ~is_val), "test_oracle": part(is_test)}
    return rounded(mt.threshold_report(part(is_test), rules), "threshold", "own_f1", "accuracy", "f1")


def q_score_summary(spark, folder):
    rows = scored(spark, folder).withColumn("score", F.col("fine_score"))
    return rounded(mt.score_summary(rows), "mean", "median", "p90", "p99")


def q_cross_entropy(spark, folder):
    return rounded(mt.cross_entropy(scored(spark, folder), ["peptide"]), "loss")


def q_class_weights(spark, folder):
    return rounded(mt.class_weights(scored(spark, folder)), "pos_weight", "weight_1", "weight_0")


def q_positive_rates(spark, folder):
    rows = sp.holdout(scored(spark, folder), "peptide")
    return rounded(mt.positive_rates(rows), "pos_rate")


def clusters(spark, folder):
    rows = table(spark, folder, "embeddings")
    first, second = F.get("embedding", 0), F.get("embedding", 1)
    cluster = F.when(F.abs(first) < 0.02, -1).when(first > 0, F.when(second > 0, 0).otherwise(1)).otherwise(2)
    return rows.select("label", cluster.alias("cluster"))


def q_cluster_ari(spark, folder):
    return rounded(mt.cluster_report(clusters(spark, folder), "label", "cluster"), "ari")


def q_fold_scores(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("fold"), "l_returnflag",
        F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("guess"),
    )
    return rounded(mt.fold_scores(rows, ["fold"], "l_returnflag", "guess"), "accuracy", "f1_macro")


def q_probe_report(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("layer"), F.col("l_linenumber").alias("fold"), "l_returnflag",
        F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("guess"),
    )
    report = mt.probe_report(mt.fold_scores(rows, ["layer", "fold"], "l_returnflag", "guess"), ["layer"])
    return rounded(report, "f1_mean", "f1_std", "accuracy_mean", "accuracy_std")


def q_fixed_step_rows(spark, folder):
    return every_nth(table(spark, folder, "events").select("event_id", "user_id"), "event_id", 1000)


def q_ordered_rank(spark, folder):
    return ordered_rank(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", "rank", "n")


QUERIES = {
    "score_curve": q_score_curve,
    "auroc": q_auroc,
    "auprc": q_auprc,
    "partial_auc": q_partial_auc,
    "overall_metrics": q_overall_metrics,
    "per_peptide_metrics": q_per_peptide,
    "saved_metrics": q_saved_metrics,
    "macro_auc": q_macro_auc,
    "best_f1_threshold": q_best_f1_threshold,
    "confusion_at": q_confusion_at,
    "threshold_report": q_threshold_report,
    "score_summary": q_score_summary,
    "cross_entropy": q_cross_entropy,
    "class_weights": q_class_weights,
    "positive_rates": q_positive_rates,
    "cluster_ari": q_cluster_ari,
    "fold_scores": q_fold_scores,
    "probe_report": q_probe_report,
    "fixed_step_rows": q_fixed_step_rows,
    "ordered_rank": q_ordered_rank,
}


def curve_sql(source, by="peptide", score="score", name="curve"):
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
    {name}_ties AS (SELECT {lead}{score}::DOUBLE AS score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg
             FROM {source} GROUP BY ALL),
    {name} AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC)::BIGINT AS tp,
                    sum(neg) OVER ({part} ORDER BY score DESC)::BIGINT AS fp,
                    sum(pos) OVER ({part})::BIGINT AS n_pos, sum(neg) OVER ({part})::BIGINT AS n_neg FROM {name}_ties)"""


def metric_sql(by="peptide", curve="curve"):
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    pieces AS (SELECT *, fp::DOUBLE / n_neg AS x1, (fp - neg)::DOUBLE / n_neg AS x0,
                      tp::DOUBLE / n_pos AS y1, (tp - pos)::DOUBLE / n_pos AS y0 FROM {curve}),
    areas AS (SELECT *, CASE WHEN x0 >= 0.1 THEN 0 WHEN x1 <= 0.1 THEN (x1 - x0) * (y0 + y1) / 2
                ELSE (0.1 - x0) * (y0 + y0 + (y1 - y0) * (0.1 - x0) / (x1 - x0)) / 2 END AS area FROM pieces),
    summed AS (SELECT {lead}any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg,
      CASE WHEN any_value(n_pos) = 0 OR any_value(n_neg) = 0 THEN 0.5
           ELSE sum(neg * (tp - pos / 2)) / (any_value(n_pos)::DOUBLE * any_value(n_neg)) END AS auroc,
      CASE WHEN any_value(n_pos) = 0 OR any_value(n_neg) = 0 THEN any_value(n_pos) / (any_value(n_pos) + any_value(n_neg))
           ELSE sum(pos * (tp / (tp + fp))) / any_value(n_pos) END AS auprc,
      CASE WHEN any_value(n_pos) = 0 OR any_value(n_neg) = 0 THEN 0.5
           ELSE 0.5 * (1 + (sum(area) - 0.005::DOUBLE) / (0.1::DOUBLE - 0.005::DOUBLE)) END AS auc01
      FROM areas {group})"""


_FINE = """fine AS (SELECT 'U' || cast(user_id % 20 AS string) AS peptide,
                 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value AS score FROM events)"""
_PER = """per AS (SELECT peptide, n_pos + n_neg AS n, n_pos, n_neg,
    CASE WHEN ok THEN round(auc01, 9) END AS auc01, CASE WHEN ok THEN round(auroc, 9) END AS auroc,
    CASE WHEN ok THEN round(auprc, 9) END AS auprc
    FROM (SELECT *, n_pos + n_neg >= 2 AND n_pos >= 1 AND n_neg >= 1 AS ok FROM summed))"""


def _by_peptide(cols):
    return with_views(f"WITH {curve_sql('scored')}, {metric_sql()} SELECT {cols} FROM summed", "scored")


_F1 = "2.0::DOUBLE * p * r / (p + r + {eps}::DOUBLE)"


def _best(eps, curve="curve", by="peptide"):
    return f"""(SELECT {by}, threshold, best_f1 FROM (
      SELECT {by}, score AS threshold, {_F1.format(eps=eps)} AS best_f1,
             row_number() OVER (PARTITION BY {by} ORDER BY {_F1.format(eps=eps)} DESC, score) AS q
      FROM (SELECT *, tp / (tp + fp) AS p, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 1 END AS r FROM {curve})) WHERE q = 1)"""


_AT = """round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
         CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0 END AS f1,
         tp + fp AS n_pred_positive, tp + fn AS n_true_positive"""
_COUNTS = """count(*) FILTER (WHERE label = 1 AND yes) AS tp, count(*) FILTER (WHERE label <> 1 AND yes) AS fp,
             count(*) FILTER (WHERE label = 1 AND NOT yes) AS fn, count(*) FILTER (WHERE label <> 1 AND NOT yes) AS tn"""
_FOLD = """
    guesses AS (SELECT l_suppkey % 4 AS layer, l_linenumber AS fold, l_returnflag AS y,
                CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS g FROM lineitem),
    seen AS (SELECT layer, fold, y AS cls, 1 AS l, 0 AS g, CASE WHEN y = g THEN 1 ELSE 0 END AS tp FROM guesses
             UNION ALL SELECT layer, fold, g, 0, 1, 0 FROM guesses)"""
_CLUSTERS = """
    c AS (SELECT label, CASE WHEN abs(embedding[1]) < 0.02 THEN -1 WHEN embedding[1] > 0 THEN
            CASE WHEN embedding[2] > 0 THEN 0 ELSE 1 END ELSE 2 END AS cluster FROM embeddings),
    k AS (SELECT * FROM c WHERE cluster <> -1),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM k GROUP BY label, cluster)) AS both_,
                 (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM k GROUP BY label)) AS a,
                 (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM k GROUP BY cluster)) AS b,
                 (SELECT count(*) * (count(*) - 1) / 2 FROM k) AS every)"""

ORACLE = {
    "score_curve": with_views(f"WITH {curve_sql('scored')} SELECT * FROM curve", "scored"),
    "auroc": _by_peptide("peptide, round(auroc, 9) AS auroc"),
    "auprc": _by_peptide("peptide, round(auprc, 9) AS auprc"),
    "partial_auc": _by_peptide("peptide, round(auc01, 9) AS auc01"),
    "overall_metrics": with_views(
        f"""WITH {curve_sql('scored', '', 'fine_score')}, {metric_sql('')}
            SELECT round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(auc01, 9) AS auc01 FROM summed""",
        "scored",
    ),
    "per_peptide_metrics": f"WITH {_FINE}, {curve_sql('fine')}, {metric_sql()}, {_PER} SELECT * FROM per",
    "saved_metrics": f"WITH {_FINE}, {curve_sql('fine')}, {metric_sql()}, {_PER} SELECT * FROM per",
    "macro_auc": f"""WITH {_FINE}, {curve_sql('fine')}, {metric_sql()}
        SELECT round(avg(auc01), 9) AS macro_auc01, count(auc01) AS n_peptides FROM summed WHERE n_pos > 0 AND n_neg > 0""",
    "best_f1_threshold": with_views(
        f"""WITH {curve_sql('scored')}
            SELECT peptide, round(threshold, 9) AS threshold, round(best_f1, 9) AS best_f1 FROM {_best('1e-8')}""",
        "scored",
    ),
    "confusion_at": with_views(
        f"""SELECT peptide, {_AT} FROM (SELECT peptide, {_COUNTS}
            FROM (SELECT *, score >= 0.5 AS yes FROM scored) GROUP BY peptide)""",
        "scored",
    ),
    "threshold_report": with_views(
        f"""WITH tagged AS (SELECT CASE WHEN peptide = 'G0' THEN 'test_oracle' WHEN peptide = 'G1' THEN 'val_optimal'
                              ELSE 'train_optimal' END AS rule, label, score FROM scored),
             {curve_sql('tagged', 'rule')},
             cuts AS (SELECT rule, threshold, best_f1 FROM {_best('1e-12', by='rule')} UNION ALL SELECT 'default_0.5', 0.5, NULL)
             SELECT rule, round(threshold, 9) AS threshold, round(best_f1, 9) AS own_f1, {_AT}
             FROM (SELECT rule, threshold, best_f1, {_COUNTS}
               FROM (SELECT rule, threshold, best_f1, label, score >= threshold AS yes FROM scored, cuts WHERE peptide = 'G0')
               GROUP BY rule, threshold, best_f1)""",
        "scored",
    ),
    "score_summary": with_views(
        """SELECT round(avg(fine_score), 9) AS mean, round(quantile_cont(fine_score, 0.5), 9) AS median,
                  round(quantile_cont(fine_score, 0.9), 9) AS p90, round(quantile_cont(fine_score, 0.99), 9) AS p99
           FROM scored""",
        "scored",
    ),
    "cross_entropy": with_views(
        """SELECT peptide, count(*) AS n, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS loss
           FROM (SELECT *, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS p FROM scored) GROUP BY peptide""",
        "scored",
    ),
    "class_weights": with_views(
        """SELECT n_pos, n_neg, round(n_neg / n_pos, 9) AS pos_weight, round((n_pos + n_neg) / (2 * n_pos), 9) AS weight_1,
                  round((n_pos + n_neg) / (2 * n_neg), 9) AS weight_0
           FROM (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM scored)""",
        "scored",
    ),
    "positive_rates": with_views(
        """WITH keys AS (SELECT peptide, row_number() OVER (ORDER BY md5(concat_ws('|', '42', peptide)), peptide) AS r,
                         count(*) OVER () AS n FROM (SELECT DISTINCT peptide FROM scored)),
           parts AS (SELECT peptide, CASE WHEN r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test'
              WHEN r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'val'
              ELSE 'train' END AS split FROM keys)
           SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_pos,
                  count(*) FILTER (WHERE label = 0) AS n_neg, round(avg(label), 9) AS pos_rate
           FROM scored JOIN parts USING (peptide) GROUP BY split""",
        "scored",
    ),
    "cluster_ari": f"""WITH {_CLUSTERS}
        SELECT round((both_ - a * b / every) / ((a + b) / 2 - a * b / every), 9) AS ari,
               (SELECT count(DISTINCT cluster) FROM k) AS n_clusters,
               (SELECT count(*) FROM c WHERE cluster = -1) AS n_noise,
               (SELECT count(DISTINCT label) FROM c) AS n_labels FROM s""",
    "fold_scores": f"""WITH {_FOLD},
        cls AS (SELECT fold, cls, sum(l) AS l, sum(g) AS g, sum(tp) AS tp FROM seen GROUP BY fold, cls)
        SELECT fold, round(sum(tp) / sum(l), 9) AS accuracy, round(avg(2.0::DOUBLE * tp / (l + g)), 9) AS f1_macro
        FROM cls GROUP BY fold""",
    "probe_report": f"""WITH {_FOLD},
        cls AS (SELECT layer, fold, cls, sum(l) AS l, sum(g) AS g, sum(tp) AS tp FROM seen GROUP BY layer, fold, cls),
        sc AS (SELECT layer, fold, sum(tp) / sum(l) AS accuracy, avg(2.0::DOUBLE * tp / (l + g)) AS f1 FROM cls GROUP BY layer, fold)
        SELECT layer, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std,
               round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std
        FROM sc GROUP BY layer""",
    "fixed_step_rows": """SELECT event_id, user_id FROM
        (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 1000 = 0""",
    "ordered_rank": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank, count(*) OVER () AS n FROM orders""",
}
