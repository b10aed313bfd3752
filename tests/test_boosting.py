"""Patience of boosted trees: which round is kept, and that the staged margins are those of the model."""

import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.operators import boosting as bo


@pytest.mark.parametrize(
    "losses, patience, expected",
    [
        ([5, 4, 4, 4, 3, 2], 3, (6, False)),  # rounds 3 and 4 are stale and round 5 helps
        ([5, 4, 4, 4, 4, 3], 3, (2, True)),  # three stale rounds end it before the better one
        ([5, 4, 6, 5, 3.9, 7, 7, 7, 1], 3, (5, True)),
        ([1, 2, 3], 3, (1, False)),
        ([1, 2, 3, 4], 3, (1, True)),
        ([], 3, (0, False)),
        ([float("nan"), 2.0, 1.0], 2, (3, False)),
    ],
)
def test_best_round(losses, patience, expected):
    assert bo.best_round(losses, patience) == expected


def test_a_round_must_help_by_the_tolerance():
    assert bo.best_round([1.0, 0.95, 0.92, 0.91], 2, 0.1) == (1, True)
    assert bo.best_round([1.0, 0.95, 0.85, 0.84], 3, 0.1) == (3, False)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for i in range(600):
        x = [rng.random() for _ in range(6)]
        made.append((i, Vectors.dense(x), float((x[0] + x[1] > 1) != (rng.random() < 0.25))))
    df = spark.createDataFrame(made, ["row_id", "features", "y"]).repartition(3).cache()
    return df.filter("row_id >= 150"), df.filter("row_id < 150")


def test_staged_margins_are_the_model_s(rows):
    train, held_out = rows
    model, _ = bo.fit_boosted(train, held_out, most=6, patience=3, maxDepth=3, stepSize=0.3)
    n = len(model.trees)
    last = bo.staged_margins(model, held_out, "row_id").select("row_id", F.size("margins").alias("n"), F.col("margins")[n - 1].alias("m"))
    for r in model.transform(held_out).join(last, "row_id").collect():
        assert r["n"] == n and r["m"] * 2 == pytest.approx(r["rawPrediction"][1] * 2, abs=1e-9)
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-2 * r["m"])), abs=1e-9)


def test_losses_and_the_cut(rows):
    train, held_out = rows
    model, losses = bo.fit_boosted(train, held_out, most=60, patience=4, tolerance=0.0, maxDepth=4, stepSize=0.3)
    best, stale = bo.best_round(losses, 4)
    assert stale and len(model.trees) == best < 60 and len(losses) == best + 4
    assert losses[best - 1] == min(losses)
    # The loss after the last kept round, from the cut model's own probabilities.
    p = F.element_at(bo.vector_to_array("probability"), 2)
    own = model.transform(held_out).agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0]
    assert own == pytest.approx(losses[best - 1], abs=1e-9)
    # A longer fit begins with the same trees.
    longer, _ = bo.fit_boosted(train, held_out.limit(0), most=best + 3, patience=4, maxDepth=4, stepSize=0.3)
    assert len(longer.trees) == best + 3 and bo.leaf_values(longer)[:best] == bo.leaf_values(model)
    assert bo.first_trees(longer, best).transform(held_out).select("prediction").collect() == model.transform(held_out).select("prediction").collect()


def test_a_round_that_is_stale_and_a_later_one_that_helps(rows):
    """With patience of one the ensemble ends at the first stale round, with more it passes over it."""
    train, held_out = rows
    settings = {"maxDepth": 1, "stepSize": 0.3}
    losses = bo.held_out_losses(bo.fit_boosted(train, held_out.limit(0), most=30, **settings)[0], held_out)
    early, late = bo.best_round(losses, 1)[0], bo.best_round(losses, 4)[0]
    assert losses[early] >= losses[early - 1] > losses[late - 1] and early < late
    for patience, n in ((1, early), (4, late)):
        assert len(bo.fit_boosted(train, held_out, most=30, patience=patience, tolerance=0.0, **settings)[0].trees) == n


def test_cut_models_are_saved(rows, tmp_path):
    train, held_out = rows
    cut = bo.first_trees(bo.fit_boosted(train, held_out.limit(0), most=5, maxDepth=2)[0], 3)
    cut.write().overwrite().save(str(tmp_path / "m"))
    again = bo.GBTClassificationModel.load(str(tmp_path / "m"))
    assert len(again.trees) == 3 and again.transform(held_out).select("probability").collect() == cut.transform(held_out).select("probability").collect()
