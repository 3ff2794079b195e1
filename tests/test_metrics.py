"""Metrics against direct computation, with ties, one class and perfect rankings."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.operators import metrics as mt


def by_hand(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    auroc = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    ap, last = 0.0, 0.0
    xs, ys = [0.0], [0.0]
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        tp, fp = int((y[hit] == 1).sum()), int((y[hit] == 0).sum())
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
        xs.append(fp / len(neg))
        ys.append(tp / len(pos))
    grid = np.array(xs)
    area = 0.0
    for i in range(1, len(xs)):
        a, b = xs[i - 1], min(xs[i], 0.1)
        if a < 0.1 and b > a:
            top = ys[i - 1] + (ys[i] - ys[i - 1]) * (b - a) / (grid[i] - grid[i - 1])
            area += (b - a) * (ys[i - 1] + top) / 2
    return auroc, ap, 0.5 * (1 + (area - 0.005) / 0.095)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(2)
    data = {}
    for g, n, levels in (("few", 40, 5), ("many", 300, 1000), ("hot", 900, 60)):
        data[g] = [(int(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(n)]
    return data


def frame(spark, data):
    rows = [(g, y, float(s)) for g, pairs in data.items() for y, s in pairs]
    return spark.createDataFrame(rows, "peptide string, label int, score double").repartition(5)


def test_rank_metrics(spark, groups):
    got = {r["peptide"]: r for r in mt.per_peptide_metrics(frame(spark, groups)).collect()}
    for g, pairs in groups.items():
        want = by_hand(*zip(*pairs))
        assert (got[g]["auroc"], got[g]["auprc"], got[g]["auc01"]) == pytest.approx(want, abs=1e-9)


def test_pooled_and_macro(spark, groups):
    df = frame(spark, groups)
    pooled = mt.overall_metrics(df).first()
    want = by_hand(*zip(*[p for pairs in groups.values() for p in pairs]))
    assert (pooled["auroc"], pooled["auprc"], pooled["auc01"]) == pytest.approx(want, abs=1e-9)
    per = mt.per_peptide_metrics(df)
    macro = mt.macro_auc01(per).first()
    assert macro["macro_auc01"] == pytest.approx(np.mean([r["auc01"] for r in per.collect()]))


def test_best_worst_and_one_class(spark):
    data = {
        "best": [(1, 0.9)] * 5 + [(0, 0.1)] * 50,
        "worst": [(1, 0.1)] * 5 + [(0, 0.5 + i / 1000) for i in range(50)],
        "ones": [(1, 0.3), (1, 0.4)],
    }
    curve = mt.score_curve(frame(spark, data), ["peptide"])
    got = {r["peptide"]: r for r in mt.rank_metrics(curve, ["peptide"]).collect()}
    assert got["best"]["auc01"] == pytest.approx(1.0) and got["best"]["auroc"] == 1.0
    assert got["worst"]["auc01"] == pytest.approx(0.5 * (1 - 0.005 / 0.095))
    assert (got["ones"]["auroc"], got["ones"]["auprc"], got["ones"]["auc01"]) == (0.5, 1.0, 0.5)
    per = {r["peptide"]: r for r in mt.per_peptide_metrics(frame(spark, data)).collect()}
    assert per["ones"]["auc01"] is None and per["ones"]["n"] == 2


def test_best_threshold_is_lowest_of_the_best(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2)], "label int, score double")
    got = mt.best_f1_threshold(mt.score_curve(df)).first()
    assert got["threshold"] == 0.7 and got["best_f1"] == pytest.approx(0.8, abs=1e-6)


def test_metrics_at(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.2)], "label int, score double")
    assert tuple(mt.metrics_at(df, 0.5).first()) == (0.5, 0.5, 2, 2)
    assert mt.metrics_at(df, 2.0).first()["f1"] == 0.0


def test_threshold_report_equals_metrics_at(spark, groups):
    df = frame(spark, groups)
    got = {r["rule"]: r for r in mt.threshold_report(df, {"own": df}).collect()}
    for name in ("own", "default_0.5"):
        want = mt.metrics_at(df, got[name]["threshold"]).first()
        assert (got[name]["accuracy"], got[name]["f1"], got[name]["n_pred_positive"]) == tuple(want)[:3]


def test_quantiles(spark):
    values = [float(v) for v in [1, 1, 2, 5, 9, 9, 9, 100, 3.5]]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    got = mt.score_summary(df).first()
    want = [np.mean(values), *np.quantile(values, [0.5, 0.9, 0.99])]
    assert tuple(got) == pytest.approx(want)


def test_rand_index(spark):
    rows = [(1, 0), (1, 0), (2, 1), (2, 1), (3, -1)]
    df = spark.createDataFrame(rows, "label int, cluster int")
    got = mt.cluster_report(df, "label", "cluster").first()
    assert tuple(got) == (1.0, 2, 1, 3)
    noise = spark.createDataFrame([(1, -1)], "label int, cluster int")
    assert mt.cluster_report(noise, "label", "cluster").first()["ari"] is None


def test_fold_scores(spark):
    df = spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "c", "a")], "fold int, y string, g string")
    got = mt.fold_scores(df, ["fold"], "y", "g").first()
    assert got["accuracy"] == 0.5
    assert got["f1_macro"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_cross_entropy_and_weights(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 1.0)], "label int, score double")
    assert mt.cross_entropy(df).first()["loss"] == pytest.approx((2 * np.log(2) - np.log(1e-7)) / 3, rel=1e-6)
    w = mt.class_weights(df).first()
    assert (w["pos_weight"], w["weight_1"], w["weight_0"]) == (2.0, 1.5, 0.75)
    assert mt.positive_rates(df.withColumn("split", F.lit("x"))).first()["pos_rate"] == pytest.approx(1 / 3)
