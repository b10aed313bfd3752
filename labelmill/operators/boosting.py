"""Boosted trees with patience: the ensemble ends at its best round once some rounds in a row have not helped.

The ensemble grows to greater lengths until the loss on the held-out rows has been stale for long enough. All rounds are
judged in one pass: a held-out row's leaves give the share of each tree in its margin, and prefix sums over the trees
give its margin after every round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.operators.trees import Trees

# Rounds in a row that may fail to help, and by how much a round must lower the loss to help.
PATIENCE, TOLERANCE = 10, 1e-4


def leaf_values(model: GBTClassificationModel) -> list[list[float]]:
    """Of each tree, the weighted values of its leaves from left to right, in which order leaves are numbered."""
    shown = ([float(v) for v in re.findall(r"Predict: (\S+)", tree.toDebugString)] for tree in model.trees)
    return [[w * v for v in values] for w, values in zip(model.treeWeights, shown, strict=True)]


def staged_margins(model: GBTClassificationModel, data: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``data`` and ``margins``: a row's margin after each round."""
    values = leaf_values(model)
    table = np.zeros((len(values), max(map(len, values))))
    for i, leaves in enumerate(values):
        table[i, : len(leaves)] = leaves

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch["leaves__"].flatten().to_numpy().astype(np.int64).reshape(-1, len(table))
            margins = table[np.arange(len(table)), leaves].cumsum(axis=1)
            bounds = np.arange(0, margins.size + 1, len(table), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.ListArray.from_arrays(bounds, pa.array(margins.reshape(-1)))], [*keep, "margins"]
            )

    scored = model.copy().setLeafCol("leaves__").transform(data).select(*keep, vector_to_array("leaves__").alias("leaves__"))
    schema = scored.select(*keep).schema.add("margins", T.ArrayType(T.DoubleType()))
    return scored.mapInArrow(sums, schema)


def held_out_losses(model: GBTClassificationModel, data: DataFrame, label: str = "y") -> list[float]:
    """Mean log-loss over ``data`` after each round; empty without rows."""
    margins = staged_margins(model, data, label)
    # The probability of the second class is the logistic function of twice the margin.
    away = F.when(F.col(label) == 1, -2.0 * F.col("margin")).otherwise(2.0 * F.col("margin"))
    loss = F.greatest(away, F.lit(0.0)) + F.log1p(F.exp(-F.abs(away)))
    rounds = margins.select(label, F.posexplode("margins").alias("round", "margin")).groupBy("round").agg(F.avg(loss).alias("loss"))
    return [r["loss"] for r in rounds.orderBy("round").collect()]


def best_round(losses: Sequence[float], patience: int, tolerance: float = 0.0) -> tuple[int, bool]:
    """The last round (from 1) that helped before ``patience`` rounds in a row did not, and whether there were so many.

    A round helps if its loss is below the least one before by more than ``tolerance``. Without losses the round is 0.
    """
    best, least = 0, float("inf")
    for i, loss in enumerate(losses, 1):
        if loss < least - (tolerance if best else 0.0):
            best, least = i, loss
        elif i - best >= patience:
            return best, True
    return best, False


def ensemble(like: GBTClassifier | GBTClassificationModel, trees: Sequence, weights: Sequence[float], features: int) -> GBTClassificationModel:
    """The model of some trees, with the parameters of an estimator or model."""
    gateway = SparkContext._active_spark_context._gateway
    kind = gateway.jvm.org.apache.spark.ml
    held, shares = gateway.new_array(kind.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        held[i], shares[i] = tree, float(weight)
    return like._copyValues(GBTClassificationModel(kind.classification.GBTClassificationModel(like.uid, held, shares, features, 2)))


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees."""
    if n >= len(model.trees):
        return model
    java = model._java_obj
    return ensemble(model, [java.trees()[i] for i in range(n)], [java.treeWeights()[i] for i in range(n)], java.numFeatures())


def fit_boosted(
    train: DataFrame,
    held_out: DataFrame,
    most: int = 500,
    patience: int = PATIENCE,
    tolerance: float = TOLERANCE,
    seed: int = 42,
    **settings,
) -> tuple[GBTClassificationModel, list[float]]:
    """An ensemble of up to ``most`` trees over ``(features, y)``, and the held-out loss after each round that was judged.

    ``2 * patience`` trees, then twice as many each time, until ``patience`` rounds in a row lower the loss by no
    more than ``tolerance`` (:func:`best_round`); the ensemble is cut after the last round that did. Without held-out rows all
    trees are fitted. ``settings`` are those of :data:`labelmill.operators.trees.SETTINGS`.
    """
    estimator = GBTClassifier(featuresCol="features", labelCol="y", seed=seed, maxIter=most, **settings)
    trees, grown = min(most, 2 * patience), Trees(train, **settings)
    try:
        while True:
            grown.grow(trees)
            model = ensemble(estimator, grown.java_trees(), [t["weight"] for t in grown.trees], grown.size)
            losses = held_out_losses(model, held_out)
            best, stale = best_round(losses, patience, tolerance)
            if stale or trees == most:
                return first_trees(model, best or trees), losses[: best + patience] if stale else losses
            trees = min(most, 2 * trees) if losses else most
    finally:
        grown.close()
