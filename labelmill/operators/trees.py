"""Boosted regression trees on sparse rows: histograms in tasks, one tree after the other, going on from what is there.

The method is that of ``GBTClassifier``: logistic loss on labels of -1 and 1, the first tree fits the labels, the others the
negative gradient, variance decides, features are binned once; a fitted ensemble is made of its trees. ``pyspark.ml`` holds
every row as an array of the bins of all features. Here a row holds only the bins that are not its features' bin of zero,
whose sums are those of the node less those of the other bins, so that work and memory follow the words of the texts.

Bins are cut at quantiles of the values of all rows, as there; a feature with zeros has a cut beside them, and its other
cuts are those of its other values. Quantiles are exact up to ``POINTS`` values in all features together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame

from labelmill.operators.networks import kept, packed, sparse_rows

# Points of all features' summaries in a task and on the driver, and at least of one feature's.
POINTS, LEAST_POINTS = 1 << 19, 64

# Trees after which rows get their margins anew, so that none but these are walked again at every level.
REFRESH = 10

# Bytes of a level's sums up to which the driver adds them up and not a second stage.
DRIVER_BYTES = 96 << 20

# Gains and variances below this are rounding.
NOTHING = 1e-12

# Settings of ``GBTClassifier`` that this method knows, and its defaults.
SETTINGS = {"maxDepth": 5, "stepSize": 0.1, "maxBins": 32, "minInstancesPerNode": 1, "minInfoGain": 0.0}


def strides(values: list[float], counts: list[float], most: int) -> list[float]:
    """At most about ``most`` cuts between ascending values that give parts of nearly equal counts; all, if there are no more."""
    if len(values) - 1 <= most:
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    stride = sum(counts) / (most + 1)
    cuts, seen, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target) and len(cuts) < most:
            cuts.append((values[i - 1] + values[i]) / 2)
            target += stride
    return cuts


def cuts_of(values: list[float], counts: list[float], zeros: float, most: int) -> list[float]:
    """Cuts of a feature from the ascending values of its cells, and the number of rows without a cell."""
    if not zeros:
        return strides(values, counts, most)
    sides = [(*zip(*[(v, c) for v, c in zip(values, counts, strict=True) if side(v)], strict=True),) for side in (lambda v: v < 0, lambda v: v > 0)]
    left = most - sum(1 for s in sides if s)
    total, cuts = sum(sum(s[1]) for s in sides if s), []
    for sign, s in zip((-1, 1), sides, strict=True):
        if s and left >= 0:
            cuts += strides(s[0], s[1], int(left * sum(s[1]) / total)) + [(s[0][-1] if sign < 0 else s[0][0]) / 2]
    return sorted(cuts)


class Trees:
    """Boosted trees over rows ``(features, y)`` with ``y`` of 0 and 1; :meth:`grow` adds trees, :meth:`java_trees` are Spark's.

    Of each tree, in the order of a heap: the feature (-1 in a leaf), the last bin that goes left, the value, the gain, and
    the number, sum and sum of squares of the rows' targets (of leaves at the greatest depth the squares of the means).
    """

    def __init__(self, data: DataFrame, **settings):
        if unknown := set(settings) - set(SETTINGS):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        self.settings = SETTINGS | settings
        first = data.select("features").first()
        if first is None:
            raise ValueError("no rows to fit trees on")
        self.context, self.size, self.trees, self._java = data.sparkSession.sparkContext, first[0].size, [], []
        blocks = packed(sparse_rows(data))
        blocks = blocks.coalesce(self.context.defaultParallelism)
        self._cut(blocks)
        self.rows = kept(self._binned(blocks))
        self.cells = self.rows.selectExpr("sum(length(slots)) div 4").first()[0]
        self.walked = 0  # trees that the rows' margins hold

    def close(self) -> None:
        self.rows.unpersist()

    def _cut(self, blocks: DataFrame) -> None:
        """Cuts of all features, one after the other's, and the first slot, the cuts and the bin of zero of each."""
        points = max(LEAST_POINTS, POINTS // self.size)

        def merged(f: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(f):
                return f, v, c
            order = np.lexsort((v, f))
            f, v, c = f[order], v[order], c[order]
            for summarised in (False, True):
                if summarised:
                    starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                    sizes = np.diff(np.append(starts, len(f)))
                    sums = np.cumsum(c)
                    base, total = np.repeat(sums[starts] - c[starts], sizes), np.repeat(np.add.reduceat(c, starts), sizes)
                    few = np.repeat(sizes <= points, sizes)
                    part = np.where(few, np.arange(len(f)), ((sums - base - c / 2) * points / total).astype(np.int64))
                else:
                    part = v
                ends = np.flatnonzero(np.append((f[1:] != f[:-1]) | (part[1:] != part[:-1]), True))
                c = np.add.reduceat(c, np.append(0, ends[:-1] + 1))
                f, v = f[ends], v[ends]
            return f, v, c

        def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, waiting, n, new = (np.zeros(0, np.int32), np.zeros(0), np.zeros(0)), [], 0, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    f, v = np.frombuffer(batch["cells"][i].as_buffer(), np.int32), np.frombuffer(batch["weights"][i].as_buffer())
                    n, new = n + len(batch["ys"][i].as_buffer()) // 4, new + len(f)
                    waiting.append((f, v, np.ones(len(f))))
                    if new > max(1 << 20, len(kept[0])):
                        kept, waiting, new = merged(*map(np.concatenate, zip(kept, *waiting, strict=True))), [], 0
            if n:
                kept = merged(*map(np.concatenate, zip(kept, *waiting, strict=True)))
                arrays = [pa.array([x.tobytes()], pa.binary()) for x in kept]
                yield pa.RecordBatch.from_arrays([pa.array([n]), *arrays], ["n", "f", "v", "c"])

        table = blocks.mapInArrow(summary, "n bigint, f binary, v binary, c binary").toArrow()
        # In an order of their own, so that the cuts do not depend on which task ended first.
        found = sorted(zip(*(table[c].to_pylist() for c in ("n", "f", "v", "c")), strict=True))
        self.n = sum(r[0] for r in found)
        f, v, c = merged(*(np.concatenate([np.frombuffer(r[k], t) for r in found]) for k, t in ((1, np.int32), (2, float), (3, float))))
        bounds = np.searchsorted(f, np.arange(self.size + 1))
        most, cuts = self.settings["maxBins"] - 1, []
        for i in range(self.size):
            a, b = bounds[i], bounds[i + 1]
            counts = c[a:b].tolist()
            cuts.append(cuts_of(v[a:b].tolist(), counts, self.n - sum(counts), most) if b > a else [])
        self.cut_counts = np.array([len(x) for x in cuts])
        self.first_cut = np.cumsum(self.cut_counts) - self.cut_counts
        self.first_slot = self.first_cut + np.arange(self.size)  # a feature has one bin more than cuts
        self.cuts = np.array([x for some in cuts for x in some], float)
        self.zero_bin = np.array([np.searchsorted(x, 0.0) for x in cuts], np.int64)
        self.slots = len(self.cuts) + self.size

    def _binned(self, blocks: DataFrame) -> DataFrame:
        """Blocks ``(ys, counts, slots, margins)``: the slots of the bins that are not those of zero, and margins of 0."""
        shared = self.context.broadcast((self.cuts, self.first_cut, self.cut_counts, self.first_slot, self.zero_bin))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, first_cut, cut_counts, first_slot, zero_bin = shared.value
            cuts = np.append(cuts, np.inf)
            for batch in batches:
                for i in range(batch.num_rows):
                    y, counts, f = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in ("ys", "counts", "cells"))
                    v = np.frombuffer(batch["weights"][i].as_buffer())
                    low, high = np.zeros(len(f), np.int64), cut_counts[f]
                    while (open_ := low < high).any():
                        middle = (low + high) // 2
                        above = cuts[first_cut[f] + middle] < v
                        low, high = np.where(open_ & above, middle + 1, low), np.where(open_ & ~above, middle, high)
                    other = low != zero_bin[f]
                    row = np.repeat(np.arange(len(y)), counts)[other]
                    made = (y, np.bincount(row, minlength=len(y)).astype(np.int32), (first_slot[f] + low)[other].astype(np.int32), np.zeros(len(y)))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], ["ys", "counts", "slots", "margins"])

        return blocks.mapInArrow(binned, "ys binary, counts binary, slots binary, margins binary")

    def _walker(self, trees: list[dict]):
        """A function of a block's row lengths and slots: the node that each row reaches in each of some trees."""
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(t["feature"][t["feature"] >= 0] for t in trees)]))
        place = np.full(self.size, -1, np.int32)
        place[used] = np.arange(len(used))
        # Of a slot, the place of its feature among those used, and the bin.
        feature_of = np.repeat(np.arange(self.size), self.cut_counts + 1)
        slot_place, slot_bin = place[feature_of], (np.arange(self.slots) - self.first_slot[feature_of]).astype(np.int16)
        zero, depth = self.zero_bin[used].astype(np.int16), self.settings["maxDepth"]
        heaps = [(np.where(t["feature"] >= 0, place[t["feature"]], -1), t["bin"]) for t in trees]

        def walk(counts: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
            every = np.arange(len(counts))
            bins = np.tile(zero, (len(counts), 1))
            at = slot_place[slots]
            known = at >= 0
            bins[np.repeat(every, counts)[known], at[known]] = slot_bin[slots[known]]
            ends = []
            for heap, last_left in heaps:
                node = np.zeros(len(counts), np.int64)
                for _ in range(depth):
                    feature = heap[node]
                    if not (inner := feature >= 0).any():
                        break
                    node = np.where(inner, 2 * node + 1 + (bins[every, feature] > last_left[node]), node)
                ends.append(node)
            return ends

        return walk

    def _margins_added(self) -> None:
        """Give the rows the margins of all trees so far."""
        new, old = self.trees[self.walked :], self.rows
        walk, values = self._walker(new), [t["value"] * t["weight"] for t in new]

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    counts, slots = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in ("counts", "slots"))
                    margins = np.frombuffer(batch["margins"][i].as_buffer()).copy()
                    for node, value in zip(walk(counts, slots), values, strict=True):
                        margins += value[node]
                    same = [batch[c].slice(i, 1) for c in ("ys", "counts", "slots")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([margins.tobytes()], pa.binary())], ["ys", "counts", "slots", "margins"])

        self.rows = kept(old.mapInArrow(added, old.schema))
        old.unpersist()
        self.walked = len(self.trees)

    def _best_splits(self, tree: dict, nodes: list[int]) -> tuple[np.ndarray, list[tuple]]:
        """Number, sum and sum of squares of each open node, and its best split: gain, feature, bin, number and sum of the left."""
        new, slots_of_all, least = self.trees[self.walked :], self.slots, self.settings["minInstancesPerNode"]
        place = np.full(len(tree["feature"]), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        many, is_first = len(nodes), not self.trees
        chunks = max(1, min(self.context.defaultParallelism, 32, self.size))
        # Chunks of whole features with as many slots each.
        bounds = np.unique(np.searchsorted(self.first_slot, np.linspace(0, slots_of_all, chunks + 1)))
        bounds[-1] = self.size
        edges = [(int(a), int(b)) for a, b in zip(bounds, bounds[1:], strict=False)]
        first_slot, names = np.append(self.first_slot, slots_of_all), ["chunk", "task", "codes", "numbers", "sums", "totals"]
        walk, values, zero_bin = self._walker([*new, tree]), [t["value"] * t["weight"] for t in new], self.zero_bin

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            numbers, sums, totals, n = np.zeros(many * slots_of_all), np.zeros(many * slots_of_all), np.zeros((3, many)), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    y, counts, slots = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in ("ys", "counts", "slots"))
                    *ends, node = walk(counts, slots)
                    target = 2.0 * y - 1.0
                    if not is_first:
                        margin = np.frombuffer(batch["margins"][i].as_buffer()).copy()
                        for end, value in zip(ends, values, strict=True):
                            margin += value[end]
                        target = 4.0 * target / (1.0 + np.exp(2.0 * target * margin))
                    at, n = place[node], n + len(y)
                    here = at >= 0
                    for k, power in enumerate((None, target, target * target)):
                        totals[k] += np.bincount(at[here], None if power is None else power[here], many)
                    cell_at = np.repeat(at, counts)
                    here = cell_at >= 0
                    code, w = cell_at[here] * slots_of_all + slots[here], np.repeat(target, counts)[here]
                    if len(numbers) > 4 * len(code):
                        np.add.at(numbers, code, 1.0)
                        np.add.at(sums, code, w)
                    else:
                        numbers += np.bincount(code, minlength=len(numbers))
                        sums += np.bincount(code, w, len(sums))
            if n:
                task = TaskContext.get().partitionId()
                # Slots that have rows, node by node, and where each chunk's begin in each node.
                full = np.flatnonzero(numbers)
                starts = np.searchsorted(full, (np.arange(many)[:, None] * slots_of_all + first_slot[[a for a, _ in edges]]).ravel())
                starts = np.append(starts, len(full))
                for k, (a, b) in enumerate(edges):
                    width = first_slot[b] - first_slot[a]
                    some = [full[starts[i * len(edges) + k] : starts[i * len(edges) + k + 1]] for i in range(many)]
                    codes = np.concatenate([x - (i * slots_of_all + first_slot[a]) + i * width for i, x in enumerate(some)])
                    some = np.concatenate(some)
                    found = (codes.astype(np.int32), numbers[some].astype(np.int32), sums[some], totals)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in found)], names)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict = {}
            for batch in batches:
                for chunk, task, *found in zip(*(batch[c].to_pylist() for c in names), strict=True):
                    parts.setdefault(chunk, []).append((task, found))
            for chunk, some in parts.items():
                a, b = edges[chunk]
                starts = first_slot[a:b] - first_slot[a]
                sizes = np.diff(first_slot[a : b + 1])
                numbers, sums, totals = np.zeros(many * sizes.sum()), np.zeros(many * sizes.sum()), np.zeros(3 * many)
                for _, (codes, x, y, z) in sorted(some, key=lambda p: p[0]):  # always in one order
                    codes = np.frombuffer(codes, np.int32)
                    numbers[codes] += np.frombuffer(x, np.int32)
                    sums[codes] += np.frombuffer(y)
                    totals += np.frombuffer(z)
                numbers, sums, totals = numbers.reshape(many, -1), sums.reshape(many, -1), totals.reshape(3, many)
                n, s = totals[0][:, None], totals[1][:, None]
                lefts = []
                for x, whole in ((numbers, n), (sums, s)):
                    x[:, starts + zero_bin[a:b]] = 0.0
                    x[:, starts + zero_bin[a:b]] = whole - np.add.reduceat(x, starts, axis=1)
                    run = np.cumsum(x, axis=1)
                    lefts.append(run - np.repeat(run[:, starts] - x[:, starts], sizes, axis=1))
                left_n, left_s = lefts
                left_n = np.rint(left_n)
                allowed = (left_n >= least) & (n - left_n >= least)
                allowed[:, starts + sizes - 1] = False
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = (left_s**2 / left_n + (s - left_s) ** 2 / (n - left_n) - s**2 / n) / n
                gains = np.where(allowed, gains, -np.inf)
                top, every = gains.argmax(axis=1), np.arange(many)
                of = np.searchsorted(starts, top, side="right") - 1
                table = np.stack([gains[every, top], of + a, top - starts[of], left_n[every, top], left_s[every, top], *totals])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["chunk", "best"])

        schema = "chunk int, task int, codes binary, numbers binary, sums binary, totals binary"
        tasks = self.context.defaultParallelism
        partials = self.rows.coalesce(tasks).mapInArrow(partial, schema)
        if 16 * min(self.cells, tasks * many * slots_of_all) > DRIVER_BYTES:
            table = partials.repartition(len(edges), "chunk").mapInArrow(best, "chunk int, best binary").toArrow()
        else:
            table = pa.Table.from_batches(best(partials.toArrow().to_batches()))
        found = [np.frombuffer(x, float).reshape(8, many) for _, x in sorted(zip(table["chunk"].to_pylist(), table["best"].to_pylist(), strict=True))]
        winner = np.argmax([x[0] for x in found], axis=0)  # the first of equal ones
        return found[0][5:], [tuple(found[w][:5, i]) for i, w in enumerate(winner)]

    def _grow_one(self) -> None:
        depth, room = self.settings["maxDepth"], 2 ** (self.settings["maxDepth"] + 1) - 1
        tree = {"feature": np.full(room, -1, np.int64), "bin": np.zeros(room, np.int64), "weight": self.settings["stepSize"] if self.trees else 1.0}
        tree |= {k: np.zeros(room) for k in ("value", "gain", "n", "s", "s2")}
        nodes = [0]
        for level in range(max(depth, 1)):
            totals, splits = self._best_splits(tree, nodes)
            opened = []
            for i, (gain, feature, last_left, left_n, left_s) in zip(range(len(nodes)), splits, strict=True):
                node, (n, s, s2) = nodes[i], totals[:, i]
                tree["n"][node], tree["s"][node], tree["s2"][node], tree["value"][node] = n, s, s2, s / n
                if level == depth or not gain > NOTHING or gain < self.settings["minInfoGain"] or s2 / n - (s / n) ** 2 < NOTHING:
                    continue
                tree["feature"][node], tree["bin"][node], tree["gain"][node] = feature, last_left, gain
                for child, (m, t) in ((2 * node + 1, (left_n, left_s)), (2 * node + 2, (n - left_n, s - left_s))):
                    tree["n"][child], tree["s"][child], tree["s2"][child], tree["value"][child] = m, t, t * t / m, t / m
                    opened.append(child)
            if not (nodes := opened):
                break
        self.trees.append(tree)

    def grow(self, most: int) -> None:
        """Add trees until there are ``most``."""
        while len(self.trees) < most:
            if len(self.trees) - self.walked >= REFRESH:
                self._margins_added()
            self._grow_one()

    def java_trees(self) -> list:
        """The trees as those of ``pyspark.ml``."""
        jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
        kind = jvm.org.apache.spark.ml

        def node(tree: dict, at: int):
            n, s, s2 = (float(tree[k][at]) for k in ("n", "s", "s2"))
            stats = gateway.new_array(jvm.double, 3)
            stats[0], stats[1], stats[2] = n, s, s2
            calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(n))
            value, impurity, feature = float(tree["value"][at]), max(s2 / n - (s / n) ** 2, 0.0), int(tree["feature"][at])
            if feature < 0:
                return kind.tree.LeafNode(value, impurity, calculator)
            split = kind.tree.ContinuousSplit(feature, float(self.cuts[self.first_cut[feature] + tree["bin"][at]]))
            return kind.tree.InternalNode(value, impurity, float(tree["gain"][at]), node(tree, 2 * at + 1), node(tree, 2 * at + 2), split, calculator)

        for tree in self.trees[len(self._java) :]:
            self._java.append(kind.regression.DecisionTreeRegressionModel(f"dtr_{len(self._java)}", node(tree, 0), self.size))
        return self._java
