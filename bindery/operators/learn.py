"""Classifiers, clusters and projections that ``pyspark.ml`` fits on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import perceptron
from bindery.operators.forest import group_scores
from bindery.operators.metrics import (
    best_f1_threshold,
    class_weights,
    fold_scores,
    metrics_at,
    overall_metrics,
    probe_report,
    score_curve,
)
from bindery.operators.order import hash_int, take_hashed
from bindery.operators.perceptron import Perceptron, fit_perceptron, save_perceptron  # noqa: F401
from bindery.operators.split import stratified_folds
from bindery.staging import ready_checkpoints, staged

#: Memory for the statistics of the nodes that one pass over the rows splits.
PASS_MEMORY_MB = 512
#: Rows that one task of a forest's fit reads; more, where there are more rows than cores take at once.
ROWS_PER_TASK = 20_000


def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """An array column as an ML vector."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add the weight n / (2 · n_class); its two values are plan constants."""
    w = class_weights(df, label).first()
    return df.withColumn(
        out, F.when(F.col(label) == 1, F.lit(w["weight_1"])).otherwise(F.lit(w["weight_0"]))
    )


def _grown_forest(
    rows: DataFrame, trees: int, depth: int, seed: int, label: str, features: str, bootstrap: bool
) -> Model:
    """A forest on rows with a ``weight``.

    The node that each row has reached is kept with the rows, so a pass ships the nodes it
    splits and not the forest grown so far; every tenth pass the row states are checkpointed.
    """
    ready_checkpoints(rows.sparkSession)
    return _unsummarised(RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol="weight", numTrees=trees, maxDepth=depth,
        seed=seed, maxBins=32, bootstrap=bootstrap, cacheNodeIds=True, checkpointInterval=10,
        maxMemoryInMB=PASS_MEMORY_MB,
    ).fit(rows))


def _unsummarised(model: Model) -> Model:
    """The model without its training summary. A summary of two classes holds the session, which
    travels with the model and cannot once anything has been observed in it."""
    model._java_obj.setSummary(SparkContext._jvm.scala.Option.empty())
    return model


def fit_forest(
    train: DataFrame, trees: int = 500, depth: int = 30, seed: int = 42,
    label: str = "label", features: str = "features",
) -> Model:
    """A random forest with balanced class weights. Spark limits trees to 30 levels."""
    return _grown_forest(with_balanced_weight(train, label), trees, depth, seed, label, features, True)


@dataclass(frozen=True)
class BaggedForest:
    """Forests fitted on rows with random weights, which tell later what each of them has seen."""

    groups: list[Model]
    key: list[str]
    seed: int

    def weight(self, group: int) -> Column:
        return bag_weight(group, self.key, self.seed)


def bag_weight(group: int, key: Sequence[str], seed: int) -> Column:
    """How often a bootstrap sample draws a row (Poisson with mean 1), from a hash of group and key."""
    u = hash_int(f"bag{seed}.{group}", *key) / float(2**32)
    times, upto, term = F.lit(0), 0.0, math.exp(-1.0)
    for n in range(1, 9):
        upto += term
        times = F.when(u >= F.lit(upto), n).otherwise(times)
        term /= n
    return times


def fit_bagged_forest(
    train: DataFrame, key: Sequence[str], trees: int = 500, depth: int = 30, groups: int = 10,
    seed: int = 42, label: str = "label", features: str = "features",
) -> BaggedForest:
    """``groups`` forests of ``trees / groups`` trees, each on its own bootstrap sample of ``train``,
    fitted side by side.

    Rows weigh as often as they are drawn, times the balanced class weight; those drawn never
    are left out of the group's fit. ``key`` identifies a row; rows with one key are drawn together.
    """
    n = train.count()
    # every task sends statistics of all nodes: the rows of one should be many, and tasks no more than run at once
    parts = max(1, min(-(-n // ROWS_PER_TASK), train.sparkSession.sparkContext.defaultParallelism))
    balanced = staged(with_balanced_weight(train, label, "_class").coalesce(parts), "balanced")
    sizes = [trees // groups + (1 if g < trees % groups else 0) for g in range(groups)]

    def group(g: int) -> Model:
        drawn = balanced.withColumn("weight", F.col("_class") * bag_weight(g, key, seed)).where("weight > 0")
        return _grown_forest(drawn.coalesce(parts), sizes[g], depth, seed + g, label, features, False)

    models = side_by_side(train.sparkSession, [partial(group, g) for g in range(groups)])
    return BaggedForest(models, list(key), seed)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], most: int = 10) -> list:
    """Results of functions that run Spark jobs, up to ``most`` at a time, each in a thread that has the
    caller's job properties. An error of any of them is raised once all have ended."""
    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _group_scores(model: BaggedForest, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One column per group with its probability of class 1."""
    names = [f"_g{g}" for g in range(len(model.groups))]
    done = df.withColumn("_groups", group_scores(df, model.groups))
    return done.select(*df.columns, *[F.col("_groups")[g].alias(n) for g, n in enumerate(names)]), names


def both_scores(model: BaggedForest, df: DataFrame) -> DataFrame:
    """Rows with ``score``, the mean of all groups, and ``unseen``, the mean of the groups that never
    drew the row (all of them, for a row that was not fitted on); null if every group drew it."""
    done, names = _group_scores(model, df)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    apart = F.array(*[F.when(model.weight(g) == 0, F.col(n)) for g, n in enumerate(names)])
    done = done.withColumn("_unseen", F.filter(apart, lambda x: x.isNotNull()))
    return done.select(
        *df.columns, mean(F.array(*names)).alias("score"),
        F.when(F.size("_unseen") > 0, mean(F.col("_unseen"))).alias("unseen"),
    )


def scored(model: Model | BaggedForest | Perceptron, df: DataFrame, out: str = "score") -> DataFrame:
    """Rows with the model's probability of class 1."""
    keep = df.columns
    if isinstance(model, Perceptron):
        return perceptron.scored(model, df, out)
    if isinstance(model, BaggedForest):
        return both_scores(model, df).withColumnRenamed("score", out).select(*keep, out)
    done = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return done.select(*keep, out)


def cross_scored(
    df: DataFrame, fit: Callable[[DataFrame], Model], k: int, key: Sequence[str],
    label: str = "label", seed: int = 42,
) -> DataFrame:
    """Every row scored by a model that did not see it (stands in for out-of-bag scores). The fits run side by side."""
    folded = staged(stratified_folds(df, label, k, key, seed), "folds")
    models = side_by_side(df.sparkSession, [partial(fit, folded.filter(F.col("fold") != i)) for i in range(k)])
    parts = [scored(model, folded.filter(F.col("fold") == i)) for i, model in enumerate(models)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def bounded_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows, by seeded order: a bound on what a model is fitted on."""
    return take_hashed(df, n, key, seed)


def linear_probe(
    df: DataFrame, label: str, vector: str, key: Sequence[str], k: int = 5,
    layer: str | None = None, seed: int = 42, max_iter: int = 1000,
) -> DataFrame:
    """Cross-validated scores of a linear classifier on vectors: mean and deviation.

    Scaling is fitted inside each fold. With ``layer`` every value of that column (few:
    the layers of a model) is probed on its own; all fits run side by side on one written table.
    Rows without a vector are left out.
    """
    usable = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    by = [layer] if layer else []
    rows = as_vector(usable, vector, "_raw").withColumn("_y", F.col(label).cast("double"))
    folded = staged(
        stratified_folds(rows.select(*by, *key, "_raw", "_y"), "_y", k, [*by, *key], seed), "folds"
    )
    layers = [r[0] for r in folded.select(layer).distinct().orderBy(layer).collect()] if layer else [None]
    counts = folded.groupBy(*by, "fold").agg(F.count("*").alias("n")).collect()

    def guessed(value, i: int) -> DataFrame:
        own = folded if value is None else folded.filter(F.col(layer) == value)
        n = sum(r["n"] for r in counts if r["fold"] != i and (value is None or r[layer] == value))
        model = _probe(n, max_iter).fit(own.filter(F.col("fold") != i))
        _unsummarised(model.stages[-1])
        done = model.transform(own.filter(F.col("fold") == i))
        return done.select(*by, "fold", "_y", F.col("prediction").alias("_guess"))

    guesses = side_by_side(df.sparkSession, [partial(guessed, value, i) for value in layers for i in range(k)])
    whole = guesses[0]
    for part in guesses[1:]:
        whole = whole.unionByName(part)
    return probe_report(fold_scores(whole, [*by, "fold"], "_y", "_guess"), by)


def _probe(n: int, max_iter: int) -> Pipeline:
    # A penalty of half the squared weights against the summed loss is 1/n per row here.
    return Pipeline(stages=[
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_scaled", labelCol="_y", family="multinomial", maxIter=max_iter,
            regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False,
        ),
    ])


def kmeans_labels(df: DataFrame, vector: str, k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Rows with the number of their k-means cluster."""
    rows = as_vector(df, vector, "_v")
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(rows.select("_v"))
    return model.transform(rows).drop("_v")


def pca_coords(df: DataFrame, vector: str) -> DataFrame:
    """Rows with the two leading principal components as ``x`` and ``y``."""
    rows = as_vector(df, vector, "_v")
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows.select("_v"))
    done = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    return done.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_v", "_p")


def report_scores(test: DataFrame, threshold: float, label: str = "label") -> dict[str, float]:
    """AUROC, AUPRC, accuracy and F1 of scored rows as plain numbers."""
    ranks = overall_metrics(test, label).first()
    at = metrics_at(test, threshold, (), label).first()
    return {
        "auroc": ranks["auroc"], "auprc": ranks["auprc"],
        "accuracy": at["accuracy"], "f1": at["f1"], "threshold": float(threshold),
    }


def f1_threshold(df: DataFrame, label: str = "label") -> float:
    """The F1-optimal threshold of scored rows."""
    return best_f1_threshold(score_curve(df, (), label)).first()["threshold"]


def save_model(model: Model | PipelineModel | BaggedForest | Perceptron, path: str, spark: SparkSession | None = None) -> None:
    """The model in a folder; a perceptron needs the session to write its tables."""
    if isinstance(model, Perceptron):
        save_perceptron(spark, model, path.rstrip("/"))
        return
    if isinstance(model, BaggedForest):
        for g, forest in enumerate(model.groups):
            save_model(forest, f"{path.rstrip('/')}/group{g}", spark)
        return
    model.write().overwrite().save(path)
