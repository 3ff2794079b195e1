"""Ranking and threshold metrics, per group and pooled, from distinct scores.

Rows are first reduced to one per (group, score), which is also what makes ties right.
Running counts over the scores are cut into cells of even size (``running_totals``), so
one group may hold every row: no group is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.constants import CALIBRATION_EPS, TRAIN_EPS
from bindery.operators.order import running_totals, value_cuts, with_value_cell


def _ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def score_curve(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """One row per group and distinct score, highest first.

    ``pos, neg``: rows with exactly this score; ``tp, fp``: rows with this score or a
    higher one; ``n_pos, n_neg``: rows of the group. Labels are 0 or 1; rows with a null
    group, label or score are left out.
    """
    slim = df.select(*by, F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("score"))
    slim = slim.dropna()
    ties = slim.groupBy(*by, "score").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")
    )
    cuts = value_cuts(slim, "score")
    celled = with_value_cell(ties, "score", "_up", cuts).withColumn("_cell", -F.col("_up"))
    curve = running_totals(
        celled, by, "_cell", [F.desc("score")],
        {"tp": F.col("pos"), "fp": F.col("neg")}, {"tp": "n_pos", "fp": "n_neg"},
    )
    return curve.select(*by, "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")


def _one_class() -> Column:
    return (F.first("n_pos") == 0) | (F.first("n_neg") == 0)


def _auroc() -> Column:
    """Share of (positive, negative) pairs ranked right; ties count half."""
    won = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    return _ratio(F.sum(won), F.first("n_pos").cast("double") * F.first("n_neg"))


def _average_precision() -> Column:
    """Sum over scores of the recall gained times the precision there."""
    gained = F.col("pos").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return _ratio(F.sum(gained), F.first("n_pos"))


def _partial_auc(max_fpr: float) -> Column:
    """Area under the curve up to ``max_fpr``, rescaled so that random is 0.5 and best is 1."""
    x1 = F.col("fp").cast("double") / F.col("n_neg")
    x0 = (F.col("fp") - F.col("neg")).cast("double") / F.col("n_neg")
    y1 = F.col("tp").cast("double") / F.col("n_pos")
    y0 = (F.col("tp") - F.col("pos")).cast("double") / F.col("n_pos")
    width = F.lit(max_fpr) - x0
    top = y0 + (y1 - y0) * width / (x1 - x0)
    area = (
        F.when((F.col("n_neg") == 0) | (F.col("n_pos") == 0), F.lit(0.0))
        .when(x0 >= max_fpr, F.lit(0.0))
        .when(x1 <= max_fpr, (x1 - x0) * (y0 + y1) / 2)
        .otherwise(width * (y0 + top) / 2)
    )
    low, high = 0.5 * max_fpr * max_fpr, max_fpr
    return 0.5 * (1 + (F.sum(area) - low) / (high - low))


def rank_metrics(curve: DataFrame, by: Sequence[str] = (), max_fpr: float = 0.1) -> DataFrame:
    """AUROC, AUPRC and partial AUC per group.

    With one class only they are 0.5, the positive rate and 0.5.
    """
    rate = F.first("n_pos") / (F.first("n_pos") + F.first("n_neg"))
    return curve.groupBy(*by).agg(
        F.first("n_pos").alias("n_pos"),
        F.first("n_neg").alias("n_neg"),
        F.when(_one_class(), F.lit(0.5)).otherwise(_auroc()).alias("auroc"),
        F.when(_one_class(), rate).otherwise(_average_precision()).alias("auprc"),
        F.when(_one_class(), F.lit(0.5)).otherwise(_partial_auc(max_fpr)).alias("auc01"),
    )


def overall_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Pooled AUROC, AUPRC and partial AUC."""
    return rank_metrics(score_curve(df, (), label, score)).select("auroc", "auprc", "auc01")


def per_peptide_metrics(
    df: DataFrame,
    peptide: str = "peptide",
    label: str = "label",
    score: str = "score",
    min_examples: int = 2,
    min_positives: int = 1,
) -> DataFrame:
    """Counts and metrics per peptide, best partial AUC first.

    Metrics are null for peptides with too few rows or positives, or without a negative.
    """
    table = rank_metrics(score_curve(df, [peptide], label, score), [peptide])
    n = F.col("n_pos") + F.col("n_neg")
    usable = (n >= min_examples) & (F.col("n_pos") >= min_positives) & (F.col("n_neg") >= 1)
    table = table.select(
        F.col(peptide).alias("peptide"), n.alias("n"), "n_pos", "n_neg",
        *[F.when(usable, F.col(m)).alias(m) for m in ("auc01", "auroc", "auprc")],
    )
    return table.orderBy(F.desc_nulls_last("auc01"), "peptide")


def macro_auc01(per_peptide: DataFrame) -> DataFrame:
    """Mean of the peptides' partial AUCs (nulls left out) and how many there are."""
    return per_peptide.agg(
        F.avg("auc01").alias("macro_auc01"), F.count("auc01").alias("n_peptides")
    )


def threshold_table(curve: DataFrame, eps: float = TRAIN_EPS) -> DataFrame:
    """Precision, recall and F1 when everything at or above each score counts as positive."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(F.lit(1.0))
    table = curve.withColumns({"precision": precision, "recall": recall})
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / (
        F.col("precision") + F.col("recall") + F.lit(eps)
    )
    return table.withColumn("f1", f1)


def best_f1_threshold(
    curve: DataFrame, by: Sequence[str] = (), eps: float = TRAIN_EPS
) -> DataFrame:
    """The score with the highest F1; of equal ones the lowest."""
    table = threshold_table(curve, eps)
    best = F.max(F.struct("f1", (-F.col("score")).alias("down"))).alias("_best")
    found = table.groupBy(*by).agg(best)
    return found.select(*by, (-F.col("_best.down")).alias("threshold"), F.col("_best.f1").alias("best_f1"))


def metrics_at(
    df: DataFrame,
    threshold: Column | float,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Accuracy, F1 (0 when undefined) and positive counts for ``score >= threshold``."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    y, yes = F.col(label) == 1, F.col(score) >= cut
    count = lambda c: F.sum(c.cast("bigint"))
    counts = df.groupBy(*by).agg(
        count(y & yes).alias("tp"), count(~y & yes).alias("fp"),
        count(y & ~yes).alias("fn"), count(~y & ~yes).alias("tn"),
    )
    return _from_confusion(counts, by)


def _from_confusion(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(
        *by,
        _ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"),
        (F.col("tp") + F.col("fp")).alias("n_pred_positive"),
        (F.col("tp") + F.col("fn")).alias("n_true_positive"),
    )


def threshold_report(
    test: DataFrame, rules: dict[str, DataFrame], label: str = "label", score: str = "score",
    eps: float = CALIBRATION_EPS,
) -> DataFrame:
    """Test metrics at 0.5 and at the F1-optimal threshold of each named table.

    ``own_f1`` is the F1 that a threshold reaches on the table it was chosen on.

    Tables are reduced to one threshold each; these few numbers become plan constants so
    that the test rows are read once for all rules.
    """
    tagged = [
        df.select(F.lit(name).alias("rule"), F.col(label), F.col(score)) for name, df in rules.items()
    ]
    whole = tagged[0]
    for more in tagged[1:]:
        whole = whole.unionByName(more)
    curve = score_curve(whole, ["rule"], label, score)
    best = best_f1_threshold(curve, ["rule"], eps).collect()
    cuts = {"default_0.5": (0.5, None), **{r["rule"]: (r["threshold"], r["best_f1"]) for r in best}}
    # One pass over the test rows: four counts per rule as plain aggregates.
    y, at = F.col(label) == 1, F.col(score)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    cells = [
        F.struct(
            F.lit(name).alias("rule"), F.lit(float(cut)).alias("threshold"),
            F.lit(own).cast("double").alias("own_f1"),
            count(y & (at >= cut)).alias("tp"), count(~y & (at >= cut)).alias("fp"),
            count(y & (at < cut)).alias("fn"), count(~y & (at < cut)).alias("tn"),
        )
        for name, (cut, own) in cuts.items()
    ]
    counts = test.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return _from_confusion(counts, ["rule", "threshold", "own_f1"])


def quantiles(df: DataFrame, score: str, points: Sequence[float]) -> DataFrame:
    """Mean and exact quantiles (linear interpolation) as ``mean, q0, q1, …``.

    Quantiles are read off the running counts of distinct scores; no task holds them all.
    """
    values = df.select(F.col(score).cast("double").alias("score")).dropna()
    ties = values.groupBy("score").agg(F.count("*").alias("n"))
    celled = with_value_cell(ties, "score", "_cell", value_cuts(values, "score"))
    run = running_totals(celled, [], "_cell", ["score"], {"upto": F.col("n")}, {"upto": "total"})
    aggs = [(F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean")]
    for i, q in enumerate(points):
        at = (F.col("total") - 1) * F.lit(float(q))
        inside = lambda pos: (F.col("upto") - F.col("n") <= pos) & (pos < F.col("upto"))
        low = F.max(F.when(inside(F.floor(at)), F.col("score")))
        high = F.max(F.when(inside(F.ceil(at)), F.col("score")))
        part = F.first(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(f"q{i}"))
    return run.agg(*aggs)


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean, median, 90th and 99th percentile."""
    found = quantiles(df, score, [0.5, 0.9, 0.99])
    return found.select("mean", F.col("q0").alias("median"), F.col("q1").alias("p90"), F.col("q2").alias("p99"))


def cross_entropy(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", clip: float = 1e-7
) -> DataFrame:
    """Mean binary cross-entropy of scores clipped to (clip, 1 - clip)."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(score).cast("double")))
    y = F.col(label).cast("double")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts, ``pos_weight`` = negatives per positive, and balanced weights."""
    y = F.col(label)
    counts = df.agg(
        F.sum((y == 1).cast("bigint")).alias("n_pos"), F.sum((y == 0).cast("bigint")).alias("n_neg")
    )
    n = F.col("n_pos") + F.col("n_neg")
    return counts.withColumns({
        "pos_weight": _ratio(F.col("n_neg"), F.col("n_pos")),
        "weight_1": _ratio(n, 2 * F.col("n_pos")),
        "weight_0": _ratio(n, 2 * F.col("n_neg")),
    })


def positive_rates(df: DataFrame, by: str = "split", label: str = "label") -> DataFrame:
    """Rows, class counts and positive rate per split or table."""
    y = F.col(label)
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.sum((y == 1).cast("bigint")).alias("n_pos"),
        F.sum((y == 0).cast("bigint")).alias("n_neg"),
        F.avg(y).alias("pos_rate"),
    )


def cluster_report(df: DataFrame, label: str, cluster: str, noise: int = -1) -> DataFrame:
    """Adjusted Rand index of clusters against labels (noise left out) and the counts.

    The index is null when every row is noise.
    """
    table = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    pairs = lambda c: c.cast("double") * (c - 1) / 2
    kept = table.filter(F.col(cluster) != noise)
    rows = kept.groupBy(label).agg(F.sum("n").alias("n"))
    cols = kept.groupBy(cluster).agg(F.sum("n").alias("n"))
    part = lambda d, name: d.select(F.lit(name).alias("part"), F.col("n"))
    parts = part(kept, "cell").unionByName(part(rows, "row")).unionByName(part(cols, "col"))
    outside = table.filter(F.col(cluster) == noise)
    # Labels seen in noise only still count as labels.
    names = table.select(label).distinct().select(F.lit("name").alias("part"), F.lit(1).cast("bigint").alias("n"))
    parts = parts.unionByName(part(outside, "noise")).unionByName(names)
    of = lambda name, c: F.coalesce(F.sum(F.when(F.col("part") == name, c)), F.lit(0))
    sums = parts.agg(
        of("cell", pairs(F.col("n"))).alias("both"),
        of("row", pairs(F.col("n"))).alias("a"),
        of("col", pairs(F.col("n"))).alias("b"),
        of("cell", F.col("n")).alias("total"),
        of("col", F.lit(1)).alias("n_clusters"),
        of("noise", F.col("n")).alias("n_noise"),
        of("name", F.lit(1)).alias("n_labels"),
    )
    every = pairs(F.col("total"))
    expected = F.col("a") * F.col("b") / every
    best = (F.col("a") + F.col("b")) / 2
    ari = (
        F.when(F.col("total") == 0, F.lit(None).cast("double"))
        .when((F.col("total") == 1) | (best == expected), F.lit(1.0))
        .otherwise((F.col("both") - expected) / (best - expected))
    )
    return sums.select(ari.alias("ari"), "n_clusters", "n_noise", "n_labels")


def fold_scores(predicted: DataFrame, by: Sequence[str], label: str, guess: str) -> DataFrame:
    """Accuracy and macro F1 of multi-class predictions per group of ``by``.

    Classes are those that occur as label or prediction in the group.
    """
    cells = predicted.groupBy(*by, label, guess).agg(F.count("*").alias("n"))
    hit = F.when(F.col(label) == F.col(guess), F.col("n")).otherwise(0)
    side = F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.col("n").alias("as_label"), F.lit(0).cast("bigint").alias("as_guess"), hit.alias("tp")),
        F.struct(F.col(guess).alias("cls"), F.lit(0).cast("bigint").alias("as_label"), F.col("n").alias("as_guess"), F.lit(0).cast("bigint").alias("tp")),
    ))
    classes = cells.select(*by, side.alias("s")).groupBy(*by, "s.cls").agg(
        F.sum("s.as_label").alias("l"), F.sum("s.as_guess").alias("g"), F.sum("s.tp").alias("tp")
    )
    f1 = 2.0 * F.col("tp") / (F.col("l") + F.col("g"))
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("l")).alias("accuracy"), F.avg(f1).alias("f1_macro")
    )


def probe_report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds, best F1 first."""
    table = scores.groupBy(*by).agg(
        F.avg("f1_macro").alias("f1_mean"), F.stddev_pop("f1_macro").alias("f1_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
    )
    return table.orderBy(F.desc("f1_mean"), *by)
