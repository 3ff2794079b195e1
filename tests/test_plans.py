"""End-to-end flows, fitting, and what the plans must not contain."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from bindery.operators import learn as ln
from bindery.operators import perceptron
from bindery.operators.features import sparse_pair_features
from bindery.operators.perceptron import Perceptron, _summed
from bindery.plans import experiments as ex
from bindery.plans.dataset import build_dataset, build_paired
from catalog import clean as qc
from catalog.views import view

LAZY = ["peptide_distance", "clean_pairs", "auroc", "per_peptide_metrics", "stratified_val", "donor_pool",
        "drop_promiscuous", "dataset_summary", "embedding_lookup", "tokenize_pad", "shuffled_pairs"]


@pytest.mark.parametrize("name", LAZY)
def test_no_product_and_no_python_in_the_plan(spark, folder, name):
    plan = entry_points.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


def test_scan_reads_only_needed_columns(spark, folder):
    plan = entry_points.queries()["class_weights"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan


def test_build_dataset(spark, folder):
    base = view(spark, folder, "positives")
    done = build_dataset(
        qc.vdjdb(spark, folder, base), qc.iedb(spark, folder, base), qc.mcpas(spark, folder, base),
        qc.tcell(spark, folder, base), view(spark, folder, "gene_ref"),
    )
    rows = done.pairs.select("split", "peptide", "cdr3", "label").collect()
    splits = {s: {r["peptide"] for r in rows if r["split"] == s} for s in ("train", "val", "test")}
    assert not (splits["train"] & splits["test"] or splits["train"] & splits["val"] or splits["val"] & splits["test"])
    known = {(r["cdr3"], r["peptide"]) for r in rows if r["label"] == 1}
    assert not any((r["cdr3"], r["peptide"]) in known for r in rows if r["label"] == 0)
    for s in splits:
        pos = sum(r["label"] == 1 for r in rows if r["split"] == s)
        assert sum(r["label"] == 0 for r in rows if r["split"] == s) <= 2 * pos
    assert done.funnel.filter("n_removed < 0").isEmpty()
    assert done.split_stats.count() == 3 and done.ratios.filter("ratio >= 5").isEmpty()
    with pytest.raises(ValueError):
        build_dataset(qc.vdjdb(spark, folder, base), qc.iedb(spark, folder, base), qc.mcpas(spark, folder, base), strategy="?")


def test_build_paired(spark, folder):
    done = build_paired(view(spark, folder, "paired"))
    assert {r[0] for r in done.select("split").distinct().collect()} == {"train", "val"}
    assert done.filter("cdr3 <> concat(cdr3a, cdr3b)").isEmpty()


@pytest.fixture(scope="module")
def learnable(spark):
    """Pairs whose label depends on the first residue of the peptide."""
    rng = random.Random(0)
    rows = []
    for i in range(240):
        y = i % 3 == 0
        rows.append((f"CASS{rng.randrange(99)}F", ("A" if y else "D") + f"{'KLMN'[i % 4]}{i}"[:8], f"V{i % 3}", "J", "a", "", "MHCI",
                     int(y), ["train", "train", "val", "test"][i % 4]))
    names = "cdr3 string, peptide string, v_gene string, j_gene string, mhc_a string, mhc_b string, mhc_class string, label int, split string"
    return spark.createDataFrame(rows, names)


def test_grid(learnable):
    run = lambda pairs, e: ex.run_forest(pairs, e, {}, trees=8, depth=4, groups=4)
    grid = [ex.Experiment("onehot_meta", categorical="one_hot"), ex.Experiment("lost", "esm/cdr3")]
    ledger = ex.run_grid(learnable, grid, run)
    row = ledger.first()
    assert ledger.count() == 1 and row["experiment_name"] == "onehot_meta"
    assert row["auroc"] > 0.6 and row["n_train"] + row["n_val"] + row["n_test"] == 240
    again = ex.run_grid(learnable, grid[:1], lambda p, e: pytest.fail("already in the ledger"), ledger)
    assert again.count() == 1


def test_perceptron(learnable, tmp_path, spark):
    row = ex.run_perceptron(learnable, ex.Experiment("onehot"), {}, hidden=(8,), rounds=12, rate=0.02, out=str(tmp_path))
    assert row["auroc"] > 0.9 and 0 <= row["threshold"] <= 1
    history = spark.read.parquet(f"{tmp_path}/onehot/model/history").orderBy("round").collect()
    assert 3 <= len(history) <= 12 and history[-1]["loss"] < history[0]["loss"]
    assert max(r["val_auroc"] for r in history) == pytest.approx(row["best_val_auroc"], abs=1e-3)
    shapes = spark.read.parquet(f"{tmp_path}/onehot/model/weights").orderBy("layer", "part").select("shape").collect()
    assert [r[0] for r in shapes] == [[990, 8], [8], [8, 1], [1]]


def test_gradient_sums_are_the_slope_of_the_loss(spark):
    rng = np.random.default_rng(0)
    model = Perceptron.start([6, 5, 3, 1], 1)
    model = Perceptron([(w.astype(np.float64), b + 0.1 * rng.random(len(b))) for w, b in model.layers])
    x, y = rng.random((40, 6)).astype(np.float32), (rng.random(40) < 0.3).astype(np.float32)
    sums, _ = model.gradients(x, y, 2.5)
    for k, array in enumerate(model.arrays()):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(4)]:
            ends = []
            for step in (1e-4, -1e-4):
                array[at] += step
                ends.append(model.gradients(x, y, 2.5)[1])
                array[at] -= step
            assert sums[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=1e-2, abs=1e-2)
    rows = [(int(b), [i for i in range(6)], [float(v) for v in a]) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "label int, places array<int>, values array<float>").repartition(7)
    for tasks in (1, 99):
        spread, loss, n = _summed(df, model, 2.5, tasks)
        assert n == 40 and loss == pytest.approx(model.gradients(x, y, 2.5)[1], rel=1e-5)
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in zip(spread, sums))
    assert _summed(df.limit(0), model, 2.5)[2] == 0


def test_positives_weigh_as_much_as_negatives(learnable, monkeypatch):
    asked = []
    plain = perceptron._summed
    monkeypatch.setattr(perceptron, "_summed", lambda rows, model, w, n: asked.append(w) or plain(rows, model, w, n))
    rows = sparse_pair_features(learnable)
    train = rows.filter("split = 'train'")
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    model, _ = ln.fit_perceptron(train, rows.filter("split = 'val'"), (4,), rounds=1, batches=2)
    assert set(asked) == {n[0] / n[1]} and len(model.history) == 1


def test_looked_up_vectors(learnable, spark):
    store = learnable.select("cdr3").distinct().withColumn("vec", F.array(F.lit(1.0), F.length("cdr3").cast("double")))
    peps = learnable.select("peptide").distinct().withColumn("vec", F.array((F.col("peptide") < "B").cast("double")))
    stores = {"esm/cdr3": (store, None), "autoencoder/plain_ae": (None, peps)}
    e = ex.Experiment("esm_cdr3_meta", "esm/cdr3", "autoencoder/plain_ae", "one_hot")
    table = ex.features_for(learnable, e, stores, learnable.filter("split = 'train'"))
    assert table.count() == 240 and table.first()["features"].size == 3 + 1 + 3 + 1


def test_calibration(learnable):
    rows = sparse_pair_features(learnable)
    report, summary = ex.calibrate(rows, lambda r: ln.fit_bagged_forest(r, ex.KEY, 6, 3, 3), folds=2)
    got = {r["rule"]: r["f1"] for r in report.collect()}
    assert set(got) == {"default_0.5", "val_optimal", "oob_optimal", "held_out_optimal", "test_oracle"}
    assert got["test_oracle"] == max(got.values())
    assert 0 <= summary.first()["median"] <= summary.first()["p99"] <= 1
    plain, _ = ex.calibrate(rows, lambda r: ln.fit_forest(r, trees=4, depth=2), folds=None)
    assert {r["rule"] for r in plain.collect()} == {"default_0.5", "val_optimal", "test_oracle"}


def test_models_travel_in_a_session_that_has_observed(spark, learnable):
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    rows = sparse_pair_features(learnable)
    assert ln.scored(ln.fit_forest(rows, trees=2, depth=2), rows).where("score between 0 and 1").count() == 240
    model = ln.fit_bagged_forest(rows, ex.KEY, 2, 2, 2)
    assert ln.both_scores(model, rows).where("score between 0 and 1").count() == 240
    two = spark.createDataFrame([(i, i % 2, [float(i % 2) + i / 100, 1.0 - i / 50]) for i in range(60)], "id int, label int, vec array<double>")
    assert ln.linear_probe(two, "label", "vec", ["id"], k=3, max_iter=20).first()["accuracy_mean"] > 0.8


def test_no_row_is_scored_by_a_group_that_drew_it(learnable, monkeypatch):
    train = sparse_pair_features(learnable).withColumn("n", F.xxhash64(*ex.KEY))
    monkeypatch.setattr(ln, "_grown_forest", lambda rows, *a: {r["n"] for r in rows.collect()})
    model = ln.fit_bagged_forest(train, ex.KEY, groups=5)
    fitted = model.groups
    drawn = [{r["n"] for r in train.where(model.weight(g) > 0).collect()} for g in range(5)]
    assert drawn == fitted and all(0.55 * 240 < len(d) < 0.72 * 240 for d in drawn)
    assert sum(train.agg(F.sum(model.weight(g))).first()[0] for g in range(5)) == pytest.approx(5 * 240, rel=0.12)
    # each group scores its own number, so the mean tells which groups took part
    told = lambda m, df: (df.withColumns({f"_g{g}": F.lit(float(2**g)) for g in range(5)}), [f"_g{g}" for g in range(5)])
    monkeypatch.setattr(ln, "_group_scores", told)
    for r in ln.both_scores(model, train).collect():
        unseen = [2**g for g in range(5) if r["n"] not in fitted[g]]
        assert r["unseen"] == (sum(unseen) / len(unseen) if unseen else None) and r["score"] == 31 / 5


def test_an_error_in_one_of_the_fits_is_raised(spark):
    def bad():
        raise ValueError("inside a fit")

    assert ln.side_by_side(spark, [lambda n=n: spark.range(n).count() for n in (3, 5)]) == [3, 5]
    with pytest.raises(ValueError, match="inside a fit"):
        ln.side_by_side(spark, [lambda: 1, bad])


def test_probe_kmeans_pca(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [float(i % 3) * 5 + rng.random(), rng.random(), rng.random()]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, label int, vec array<double>")
    probe = ln.linear_probe(df, "label", "vec", ["id"], k=3, max_iter=50).first()
    assert probe["accuracy_mean"] > 0.95 and probe["f1_std"] < 0.2
    from bindery.operators.metrics import cluster_report

    assert cluster_report(ln.kmeans_labels(df, "vec", 3), "label", "cluster").first()["ari"] > 0.9
    coords = ln.pca_coords(df, "vec")
    assert coords.count() == 90 and coords.agg(F.stddev("x")).first()[0] > coords.agg(F.stddev("y")).first()[0]


def test_balanced_weights(learnable):
    weighted = ln.with_balanced_weight(learnable).groupBy("label").agg(F.sum("weight")).collect()
    assert {round(r[1], 6) for r in weighted} == {120.0}


def test_errors_in_a_run_are_not_swallowed(spark, learnable):
    def broken(pairs, experiment):
        raise ValueError("inside the fit")

    with pytest.raises(ValueError, match="inside the fit"):
        ex.run_grid(learnable, [ex.Experiment("one")], broken)
