"""Boosted trees on sparse rows: cuts, bins of zero, and that trees are those of ``pyspark.ml`` and do not depend on how they grow."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.operators import boosting as bo
from labelmill.operators import trees as tr


@pytest.fixture(scope="module")
def sparse(spark):
    """Few values, zeros and negative ones among them, one dense row and one without values."""
    rng, made = random.Random(8), []
    for i in range(300):
        at = sorted(rng.sample(range(9), 4))
        x = Vectors.sparse(9, at, [float(rng.choice([-2, -1, 0, 1, 2, 3])) + 0.01 * k for k in at])
        if i == 3:
            x = Vectors.sparse(9, [], [])
        made.append((i, Vectors.dense(x.toArray()) if i == 5 else x, float((x[0] + x[3] + x[7] > 1) != (rng.random() < 0.1))))
    return spark.createDataFrame(made, ["row_id", "features", "y"]).repartition(3).cache()


def margins(model, df):
    return [r[0] for r in bo.staged_margins(model, df, "row_id").orderBy("row_id").select("margins").collect()]


def test_trees_are_those_of_pyspark_ml(sparse):
    """With all values as cuts both see the same; margins of all rounds agree."""
    own, _ = bo.fit_boosted(sparse, sparse.limit(0), most=4, maxDepth=3, stepSize=0.2)
    theirs = GBTClassifier(featuresCol="features", labelCol="y", maxIter=4, maxDepth=3, stepSize=0.2, seed=42).fit(sparse)
    assert np.allclose(margins(own, sparse), margins(theirs, sparse), atol=1e-9)
    assert own.getMaxDepth() == 3 and own.numFeatures == 9 and own.treeWeights == theirs.treeWeights


@pytest.mark.parametrize("name, value", [("REFRESH", 2), ("DRIVER_BYTES", 0)])
def test_margins_that_rows_hold_and_the_place_of_sums_change_nothing(sparse, monkeypatch, name, value):
    whole, _ = bo.fit_boosted(sparse, sparse.limit(0), most=6, maxDepth=3)
    monkeypatch.setattr(tr, name, value)
    again, _ = bo.fit_boosted(sparse, sparse.limit(0), most=6, maxDepth=3)
    assert np.allclose(margins(whole, sparse), margins(again, sparse), atol=1e-9)


def test_trees_are_not_fitted_twice(sparse, monkeypatch):
    """A longer ensemble goes on from the shorter one."""
    grown, one = [], tr.Trees._grow_one
    monkeypatch.setattr(tr.Trees, "_grow_one", lambda self: (grown.append(1), one(self)))
    model, losses = bo.fit_boosted(sparse, sparse, most=5, patience=1, tolerance=-9.0, maxDepth=1)
    assert len(model.trees) == len(losses) == len(grown) == 5


def test_cuts():
    assert tr.strides([1.0, 2.0, 4.0], [1, 1, 1], 5) == [1.5, 3.0]
    assert tr.strides([float(i) for i in range(8)], [1] * 8, 3) == [1.5, 3.5, 5.5]
    assert tr.cuts_of([1.0, 2.0], [1, 1], 5, 5) == [0.5, 1.5]
    assert tr.cuts_of([-4.0, -2.0, 6.0], [1, 1, 1], 5, 5) == [-3.0, -1.0, 3.0]
    assert tr.cuts_of([float(i) for i in range(1, 101)], [1] * 100, 9900, 3) == [0.5, 33.5, 67.5]
    assert tr.cuts_of([0.0], [2], 5, 5) == []


def test_one_leaf_and_unknown_settings(sparse):
    same = sparse.withColumn("y", F.lit(1.0))
    model, _ = bo.fit_boosted(same, same.limit(0), most=2, maxDepth=2)
    assert [t.numNodes for t in model.trees] == [1, 1] and {r["prediction"] for r in model.transform(same).collect()} == {1.0}
    with pytest.raises(ValueError, match="unknown settings"):
        bo.fit_boosted(sparse, sparse, most=2, subsamplingRate=0.5)
    with pytest.raises(ValueError, match="no rows"):
        bo.fit_boosted(sparse.limit(0), sparse, most=2)
