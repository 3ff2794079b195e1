"""Forest scores by batches against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from bindery.operators import learn as ln
from bindery.operators.forest import Tree, group_scores


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that no single number tells, in dense and sparse vectors, one of them empty."""
    made = []
    for i in range(300):
        x = [float(i % 7), (i * 37 % 101) / 10.0, 0.0, -1.0 if i % 3 else 0.0]
        kind = Vectors.dense(x) if i % 2 else Vectors.sparse(4, {k: v for k, v in enumerate(x) if v})
        made.append((i, int((i % 7 + i * 37 % 101) % 2), kind, 1.0))
    made.append((300, 1, Vectors.sparse(4, {}), 1.0))
    return spark.createDataFrame(made, ["id", "label", "features", "weight"])


def test_batches_score_like_transform(rows):
    forests = [
        RandomForestClassifier(weightCol="weight", numTrees=t, maxDepth=d, seed=t).fit(rows)
        for t, d in ((5, 8), (3, 2), (1, 0))  # the last is a single leaf
    ]
    got = {r["id"]: r["s"] for r in rows.select("id", group_scores(rows, forests).alias("s")).collect()}
    for g, forest in enumerate(forests):
        for r in forest.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect():
            assert got[r["id"]][g] == r["p"]


def test_scores_do_not_walk_trees_row_by_row(rows, monkeypatch):
    model = ln.fit_bagged_forest(rows.drop("weight"), ["id"], 4, 4, 2)
    for forest in model.groups:
        monkeypatch.setattr(forest, "transform", lambda *_: pytest.fail("row by row"))
    assert ln.both_scores(model, rows).where("score between 0 and 1").count() == 301


def test_folds_are_fitted_side_by_side(rows):
    import threading

    met = threading.Barrier(3)

    def fit(train):
        met.wait(60)
        return ln.fit_bagged_forest(train, ["id"], 2, 2, 2)

    assert ln.cross_scored(rows.drop("weight"), fit, 3, ["id"]).where("score is not null").count() == 301


def test_a_tree_reads_answers_test_by_test():
    # node 0 asks test 1, node 2 asks test 0; nodes 1, 3 and 4 are leaves
    tree = Tree(np.repeat([1, 0, 0, 0, 0], 2), 2 * np.array([1, 2, 1, 1, 3, 4, 3, 3, 4, 4]), np.zeros((5, 2)), 2)
    passed = np.array([[0, 1, 0, 1, 1], [0, 0, 1, 1, 1]], np.int8)
    assert tree.leaves(passed).tolist() == [1, 1, 3, 4, 4]
