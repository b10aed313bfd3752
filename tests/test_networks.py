"""Neural students: the loss and gradient over sparse rows, the model made of the weights, the search for weights."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.operators import networks as nw

SCHEMA = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("features", VectorUDT())])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    found = []
    for i in range(60):
        at = sorted(rng.choice(12, 3, replace=False).tolist())
        vector = Vectors.sparse(12, at, rng.normal(size=3).tolist())
        found.append((float(i % 3), Vectors.dense(vector.toArray()) if i == 7 else Vectors.sparse(12, [], []) if i == 8 else vector))
    return spark.createDataFrame(found, SCHEMA).repartition(3).cache()


def test_loss_is_that_of_the_model_and_the_gradient_its_slope(rows):
    layers = [12, 5, 4, 3]
    estimator = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=layers)
    weights, sparse = nw.first_weights(layers, 1), nw.sparse_rows(rows)
    loss, n, gradient = nw.loss_sums(sparse, layers, weights)
    truth = vector_to_array("probability")[F.col("y").cast("int")]
    expected = nw.network(estimator, weights).transform(rows).agg(F.sum(-F.log(truth))).first()[0]
    assert n == 60 and loss == pytest.approx(expected)
    for k in (0, 7, 33, 61, len(weights) - 1):
        moved = weights.copy()
        moved[k] += 1e-5
        assert gradient[k] == pytest.approx((nw.loss_sums(sparse, layers, moved, gradient=False)[0] - loss) / 1e-5, abs=1e-3)


def test_gradients_are_added_by_executors_if_there_are_many(rows, monkeypatch):
    layers = [12, 4, 3]
    weights, sparse = nw.first_weights(layers, 1), nw.sparse_rows(rows)
    loss, n, gradient = nw.loss_sums(sparse, layers, weights)
    monkeypatch.setattr(nw, "MOST_PARTIALS", 2)
    again = nw.loss_sums(sparse, layers, weights)
    assert again[1] == n and again[0] == pytest.approx(loss) and np.allclose(again[2], gradient, atol=1e-4)


def test_search_reaches_the_minimum():
    def value(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, history = nw.minimise(value, np.array([-1.2, 1.0]), 100, 1e-9)
    assert np.allclose(x, 1, atol=1e-3) and all(b <= a for a, b in zip(history, history[1:], strict=False))


@pytest.mark.parametrize("often, most_rows, most_cells", [(0.0, 7, 1 << 20), (2.0, 2048, 1 << 20), (0.3, 2048, 5)])
def test_blocks_give_the_sums_of_rows(rows, monkeypatch, often, most_rows, most_cells):
    """Whether features are widened or multiplied cell by cell, and however many rows and cells a block has."""
    layers = [12, 5, 3]
    weights, sparse = nw.first_weights(layers, 1), nw.sparse_rows(rows)
    loss, n, gradient = nw.loss_sums(sparse, layers, weights)
    monkeypatch.setattr(nw, "OFTEN", often)
    monkeypatch.setattr(nw, "BLOCK_ROWS", most_rows)
    monkeypatch.setattr(nw, "BLOCK_CELLS", most_cells)
    blocks = nw.packed(sparse)
    sizes = blocks.selectExpr("length(ys) / 4 AS n", "length(cells) / 4 AS m").collect()
    assert sum(r["n"] for r in sizes) == 60 and all(r["n"] <= most_rows and (r["m"] <= most_cells or r["n"] == 1) for r in sizes)
    for kind, near in ((float, 1e-9), (np.float32, 1e-4)):
        again = nw.loss_sums(blocks, layers, weights.astype(kind))
        assert again[1] == n and again[0] == pytest.approx(loss, rel=near) and np.allclose(again[2], gradient, atol=1e-4)


def test_a_search_goes_on_where_another_ended():
    def value(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    start, memory = np.array([-1.2, 1.0]), nw.Memory()
    whole, history = nw.minimise(value, start, 20, 1e-9)
    half, first = nw.minimise(value, start, 8, 1e-9, memory)
    rest, second = nw.minimise(value, half, 12, 1e-9, memory)
    assert np.allclose(rest, whole, rtol=1e-12) and first + second[1:] == pytest.approx(history, rel=1e-9)
