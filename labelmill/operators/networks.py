"""Neural students on sparse rows: L-BFGS on the driver, loss and gradient over all rows in tasks.

The network is that of ``MultilayerPerceptronClassifier`` (sigmoid layers, softmax on top, mean cross-entropy), and a
fitted one is its model. ``pyspark.ml`` widens every row to the whole vocabulary and keeps
twenty vectors of weights in the driver's heap. Here rows are packed into blocks once, a task takes a block at a time,
and in the first layer only the features that many of its rows have are widened; the others are multiplied cell by
cell, so that work and memory follow the words of the texts. One sum of gradients comes from each task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import limit_batches, materialise

# Rows and cells of a block, which a task takes at a time (a longer row is a block of its own).
BLOCK_ROWS, BLOCK_CELLS = 2048, 1 << 20

# Features that more than this share of a block's rows have are widened; bytes that the others gather at a time.
OFTEN, GATHER_BYTES = 0.05, 1 << 20

# Gradients that the driver adds up itself; more are added up by executors first.
MOST_PARTIALS = 32

# Pairs that the optimiser remembers, steps that a line search tries, iterations without a gain before the end.
CORRECTIONS, LINE_STEPS, WINDOW = 10, 20, 10
DECREASE, CURVATURE = 1e-4, 0.9


def first_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights, wide enough for sigmoid layers to tell rows apart from the start (Glorot and Bengio's); no biases."""
    rng = np.random.default_rng(seed)
    wide = lambda n, m: 4.0 * np.sqrt(6.0 / (n + m))
    return np.concatenate([np.append(rng.uniform(-1.0, 1.0, n * m) * wide(n, m), np.zeros(m)) for n, m in zip(layers, layers[1:], strict=False)])


def sparse_rows(data: DataFrame) -> DataFrame:
    """``(y, idx, w)`` of rows ``(features, y)``; a dense vector holds every index."""
    parts = F.unwrap_udt(F.col("features"))
    every = F.when(F.size(parts["values"]) > 0, F.sequence(F.lit(0), F.size(parts["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return data.select(F.col("y").cast("int").alias("y"), F.coalesce(parts["indices"], every).alias("idx"), parts["values"].alias("w"))


def packed(rows: DataFrame) -> DataFrame:
    """Rows ``(y, idx, w)`` as blocks ``(ys, counts, cells, weights)``: 32-bit integers, and doubles, one array each."""
    limit_batches(rows.sparkSession)
    most_rows, most_cells = BLOCK_ROWS, BLOCK_CELLS

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        def whole(arrays: list[pa.Array], kind: type) -> pa.Array:
            return pa.array([np.concatenate([a.to_numpy(zero_copy_only=False) for a in arrays]).astype(kind).tobytes()], pa.binary())

        counts = whole([p["idx"].value_lengths() for p in parts], np.int32)
        cells, weights = whole([p["idx"].flatten() for p in parts], np.int32), whole([p["w"].flatten() for p in parts], np.float64)
        return pa.RecordBatch.from_arrays([whole([p["y"] for p in parts], np.int32), counts, cells, weights], ["ys", "counts", "cells", "weights"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, cells = [], 0, 0
        for batch in batches:
            counts, start = batch["idx"].value_lengths().to_pylist(), 0
            for i, count in enumerate(counts):
                if n and (n == most_rows or cells + count > most_cells):
                    yield made([*parts, batch.slice(start, i - start)])
                    parts, n, cells, start = [], 0, 0, i
                n, cells = n + 1, cells + count
            if start < len(counts):
                parts.append(batch.slice(start))
        if n:
            yield made(parts)

    return rows.select("y", "idx", "w").mapInArrow(blocks, "ys binary, counts binary, cells binary, weights binary")


def kept(blocks: DataFrame) -> DataFrame:
    """Blocks that many jobs read: written once, so that no job plans anew how they were made, in row groups that can be dealt out, and persisted."""
    return materialise(blocks, "blocks", **{"parquet.block.size": str(4 << 20)}).persist(StorageLevel.MEMORY_AND_DISK)


def loss_sums(rows: DataFrame, layers: Sequence[int], weights: np.ndarray, gradient: bool = True) -> tuple[float, int, np.ndarray | None]:
    """Sum of the cross-entropy over ``(y, idx, w)`` or their blocks, the number of rows, and the sum of the gradients.

    Products are of the precision of ``weights``, sums over rows are double.
    """
    layers, often_share, gather_bytes = list(layers), OFTEN, GATHER_BYTES
    rows = rows if "cells" in rows.columns else packed(rows)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(weights)

    # What tasks run is made here, so that it travels to the executors by value.
    def shaped(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at, found = 0, []
        for n, m in zip(layers, layers[1:], strict=False):
            found.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return found

    def add_products(counts: np.ndarray, cells: np.ndarray, w: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> None:
        """Add to each row of ``out`` its weighted rows of ``matrix``; rows with as many cells go together."""
        starts, order = np.cumsum(counts) - counts, np.argsort(counts, kind="stable")
        sizes, first = np.unique(counts[order], return_index=True)
        for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            if not size:
                continue
            span, step = np.arange(size), max(1, gather_bytes // (size * matrix.shape[1] * matrix.itemsize))
            for k in range(a, b, step):
                some = order[k : min(k + step, b)]
                at = starts[some][:, None] + span
                out[some] += np.matmul(w[at][:, None, :], matrix[cells[at]])[:, 0]

    def block(y: np.ndarray, counts: np.ndarray, idx: np.ndarray, w: np.ndarray, net: list, sums: list | None) -> float:
        matrix, bias = net[0]
        every, row, w = np.arange(len(y)), np.repeat(np.arange(len(y), dtype=np.int32), counts), w.astype(matrix.dtype)
        often = np.bincount(idx, minlength=len(matrix)) > often_share * len(y)
        present, is_often = np.flatnonzero(often), often[idx]
        wide = np.zeros((len(y), len(present)), matrix.dtype)
        wide[row[is_often], (np.cumsum(often) - 1)[idx[is_often]]] = w[is_often]
        row, idx, w = row[~is_often], idx[~is_often], w[~is_often]
        z = wide @ matrix[present] + bias
        add_products(np.bincount(row, minlength=len(y)), idx, w, matrix, z)
        outputs, last = [wide], len(net) - 1
        for i in range(last):
            outputs.append(1.0 / (1.0 + np.exp(-np.clip(z, -80.0, 80.0))))
            z = outputs[-1] @ net[i + 1][0] + net[i + 1][1]
        z = z.astype(float)
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        loss = -float(log_p[every, y].sum())
        if sums is None:
            return loss
        delta = np.exp(log_p)
        delta[every, y] -= 1.0
        delta = delta.astype(matrix.dtype)
        for i in range(last, -1, -1):
            sums[i][1][:] += delta.sum(axis=0)
            if i:
                sums[i][0][:] += outputs[i].T @ delta
                delta = (delta @ net[i][0].T) * outputs[i] * (1.0 - outputs[i])
        sums[0][0][present] += wide.T @ delta
        # Few bits sort by counting.
        by_feature = np.argsort(idx.astype(np.uint16) if len(matrix) <= 1 << 16 else idx, kind="stable")
        add_products(np.bincount(idx, minlength=len(matrix)), row[by_feature], w[by_feature], delta, sums[0][0])
        return loss

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shaped(shared.value)
        total = np.zeros(len(shared.value)) if gradient else None
        sums = shaped(total) if gradient else None
        loss, n = 0.0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                y, counts, idx = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in ("ys", "counts", "cells"))
                loss += block(y, counts, idx, np.frombuffer(batch["weights"][i].as_buffer()), net, sums)
                n += len(y)
        if n:
            sent = total.astype(np.float32).tobytes() if gradient else b""
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([sent], pa.binary())], ["loss", "n", "gradient"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, None
        for batch in batches:
            for one, rows_, sent in zip(*(batch[c].to_pylist() for c in ("loss", "n", "gradient")), strict=True):
                loss, n = loss + one, n + rows_
                values = np.frombuffer(sent, np.float32)
                total = values.astype(float) if total is None else total + values
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["loss", "n", "gradient"])

    schema = "loss double, n bigint, gradient binary"
    partials = rows.coalesce(context.defaultParallelism).mapInArrow(partial, schema)
    if gradient and context.defaultParallelism > MOST_PARTIALS:
        partials = partials.repartition(MOST_PARTIALS).mapInArrow(added, schema)
    table = partials.toArrow()
    shared.destroy()
    loss, n = sum(table["loss"].to_pylist()), sum(table["n"].to_pylist())
    if not gradient:
        return loss, n, None
    total = np.zeros(len(weights))
    for sent in table["gradient"]:
        total += np.frombuffer(sent.as_buffer(), np.float32)
    return loss, n, total


@dataclass
class Memory:
    """What a search that goes on from the point of another needs of it: the pairs, and the point's value and gradient."""

    pairs: deque = field(default_factory=lambda: deque(maxlen=CORRECTIONS))
    point: np.ndarray | None = None
    known: tuple[float, np.ndarray] | None = None


def minimise(
    value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, most: int, tolerance: float, memory: Memory | None = None
) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with a line search for a sufficient decrease and curvature; the point, and the value at every iteration.

    It ends after ``most`` iterations, when the gradient is small against the value, when ``WINDOW`` iterations together
    gain less than ``tolerance`` of the first value, or when no step along the direction lowers the value. With the
    ``memory`` of the search that ended at ``start`` it goes on as that one would have; its vectors are of the precision of ``start``.
    """
    memory = Memory() if memory is None else memory
    x, pairs = start, memory.pairs
    if memory.point is not start:
        pairs.clear()
        memory.known = value(x)
    f, g = memory.known
    history = [f]
    for _ in range(most):
        if np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
        direction = -g
        shares = []
        for s, y, rho in reversed(pairs):
            shares.append(rho * float(s @ direction))
            direction -= shares[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            direction *= 1.0 / (rho * float(y @ y))
        for (s, y, rho), share in zip(pairs, reversed(shares), strict=True):
            direction += (share - rho * float(y @ direction)) * s
        slope = float(g @ direction)
        if slope >= 0:
            pairs.clear()
            direction, slope = -g, -float(g @ g)
        step = 1.0 if pairs else 1.0 / float(np.linalg.norm(direction))
        low, high, best = 0.0, float("inf"), None
        for _ in range(LINE_STEPS):
            at = x + step * direction
            f_at, g_at = value(at)
            if not f_at <= f + DECREASE * step * slope:
                high = step
            else:
                best = (at, f_at, g_at, step)
                if float(g_at @ direction) >= CURVATURE * slope:
                    break
                low = step
            step = (low + high) / 2 if high < float("inf") else 2 * low
        if best is None:
            break
        at, f_at, g_at, step = best
        s, y = (step * direction).astype(np.float32), (g_at - g).astype(np.float32)
        if (curve := float(s @ y)) > 1e-10 * float(y @ y):
            pairs.append((s, y, 1.0 / curve))
        x, f, g = best[:3]
        history.append(f)
        if len(history) > WINDOW and max(history[-WINDOW - 1 :]) - f <= tolerance * abs(history[0]):
            break
    memory.point, memory.known = x, (f, g)
    return x, history


def fit_weights(
    estimator: MultilayerPerceptronClassifier, rows: DataFrame, start: np.ndarray | None = None, memory: Memory | None = None
) -> tuple[np.ndarray, list[float]]:
    """Weights of the estimator's network after its iterations over ``(y, idx, w)`` or blocks, and the mean loss at each.

    Weights, products and vectors of the search are of single precision.
    """
    layers = estimator.getLayers()

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, n, gradient = loss_sums(rows, layers, weights)
        return loss / max(n, 1), (gradient / max(n, 1)).astype(np.float32)

    start = first_weights(layers, estimator.getSeed()).astype(np.float32) if start is None else start
    return minimise(value, start, estimator.getMaxIter(), estimator.getTol(), memory)


def network(estimator: MultilayerPerceptronClassifier, weights: np.ndarray) -> MultilayerPerceptronClassificationModel:
    """The estimator's model with the given weights."""
    context = SparkContext._active_spark_context
    estimator._transfer_params_to_java()
    java = estimator._java_obj
    made = context._gateway.jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
        estimator.uid, _py2java(context, Vectors.dense(weights))
    )
    return MultilayerPerceptronClassificationModel(java.copyValues(made, java.extractParamMap()))


def fit_network(estimator: MultilayerPerceptronClassifier, data: DataFrame) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """The estimator's model of rows ``(features, y)``, and its mean loss at every iteration."""
    rows = kept(packed(sparse_rows(data)))
    try:
        weights, history = fit_weights(estimator, rows)
    finally:
        rows.unpersist()
    return network(estimator, weights), history
