"""Embedding near-dedup: exact metric range join of unit vectors around pivots.

On unit vectors, a cosine of at least ``t`` is a Euclidean distance of at most ``r = sqrt(2 - 2t)``. Some vectors of each
label are pivots, and every vector is at home in the cell of its nearest pivot. By the triangle inequality a partner of
a vector at home with pivot ``p`` is at most ``2r`` farther from ``p`` than from its own pivot: to that boundary a vector
is repeated in other cells. Within a cell, partners' distances to the pivot differ by ``r`` at most, so each ring of
width ``r`` meets its two neighbours only. Cells and rings join independently; large ones are split into blocks.

Equal vectors of a label are one class that counts as often as it occurs. Blocks return counts and a spanning forest
of their links, so a dense group costs rows in proportion to its size, not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import shipped
from labelmill.llm.components import components
from labelmill.session import materialise

CELL_ROWS = 4096
CHUNK_ROWS = 8192
BLOCK_ROWS = 2048

# Distances are compared with this much to spare, so that rounding loses no pair before the exact test.
SLACK = 1e-9


def _raw(table: pa.Table) -> np.ndarray:
    values = table["embedding"].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Least node of each node's component under the links ``a[i] - b[i]``; nodes are numbered in order of their ids."""
    label = np.arange(nodes)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Group vectors: ``(vec_id, n_links, component_id, kept)``, one row per row.

    ``vectors`` needs ``vec_id`` (bigint), ``embedding`` (array of numbers) and ``label``. Two vectors are linked when
    their labels are equal and not null and their cosine, in double precision, is at least ``threshold``. Vectors that
    are null, zero, hold a null or a number that isn't finite, or have another dimension link with nothing. A row with a
    null id links with nothing and is kept. Extra columns are ignored.
    """
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + SLACK
    kind = vectors.schema["label"].dataType
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    largest = F.array_max(F.transform("embedding", F.abs))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & (largest > 0) & (largest < float("inf"))
    usable = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # The label of unusable rows is left out, so that they never meet anything.
    rows = rows.withColumn("of", F.when(usable, F.col("label"))).withColumn("dim", F.size("embedding"))
    grouped = rows.filter(F.col("of").isNotNull()).groupBy(F.col("of").alias("label"), "dim", "embedding")
    classes = materialise(grouped.agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes")

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("sure"))
    sizes = materialise(sizes, "sizes")
    plus = classes.join(sizes, ["label", "dim"])
    unit = F.xxhash64("node", F.lit("pivot")).cast("double") / 2.0**64 + 0.5
    chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    pivots = plus.filter((F.col("node") == F.col("sure")) | (unit < (F.ceil(F.col("n") / cell_rows) - 1) / F.col("n")))
    met = materialise(
        pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("label", "dim", "chunk", "node", "embedding"), "pivots"
    )
    dealt = plus.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).select("label", "dim", "chunk", "node", "weight", "embedding")

    def place(key: tuple, table: pa.Table, around: pa.Table) -> pa.Table:
        order = np.argsort(around["node"].to_numpy())
        names = around["node"].to_numpy()[order]
        distance = _distances(_unit(_raw(table)), _unit(_raw(around))[order])
        home = distance.argmin(axis=1)
        nearest = distance.min(axis=1)
        at, cell = np.nonzero(distance <= (nearest + 2 * radius)[:, None])
        ring = np.floor(distance[at, cell] / radius).astype(np.int32)
        own = np.flatnonzero(cell == home[at])
        row = np.concatenate([at[own], at, at, at])
        side = np.concatenate([np.zeros(len(own), np.int32), np.ones(3 * len(at), np.int32)])
        cells, rings = np.concatenate([cell[own], cell, cell, cell]), np.concatenate([ring[own], ring - 1, ring, ring + 1])
        out = table.select(["label", "dim", "node", "weight", "embedding"]).take(pa.array(row))
        for name, values in (("cell", names[cells]), ("ring", rings.astype(np.int32)), ("side", side)):
            out = out.append_column(name, pa.array(values))
        return out

    field = T.StructField
    row_fields = [field("label", kind), field("dim", T.IntegerType()), field("node", T.LongType()), field("weight", T.LongType()), field("embedding", T.ArrayType(T.DoubleType()))]
    placed_type = T.StructType([*row_fields, field("cell", T.LongType()), field("ring", T.IntegerType()), field("side", T.IntegerType())])
    group = ["label", "dim", "chunk"]
    placed = materialise(shipped(dealt).groupBy(*group).cogroup(met.groupBy(*group)).applyInArrow(place, placed_type), "placed")

    ring = ["label", "dim", "cell", "ring"]
    counts = placed.groupBy(*ring).agg(F.sum(1 - F.col("side")).alias("homes"), F.sum("side").alias("others")).filter("homes > 0")
    home_blocks, other_blocks = (F.ceil(F.col(c) / block_rows).cast("int") for c in ("homes", "others"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, home_blocks).otherwise(other_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, other_blocks).otherwise(home_blocks) - 1))
    blocks = placed.join(counts, ring).withColumn("mine", mine).withColumn("theirs", other)
    blocks = blocks.withColumns({
        "hi": F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("theirs")),
        "oj": F.when(F.col("side") == 0, F.col("theirs")).otherwise(F.col("mine")),
    }).select(*ring, "hi", "oj", "side", "node", "weight", "embedding")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        side, node, weight, raw = table["side"].to_numpy(), table["node"].to_numpy(), table["weight"].to_numpy(), _raw(table)
        largest = np.abs(raw).max(axis=1)[:, None]
        raw = raw / largest  # cosines don't change, and squares can't overflow
        norm = np.sqrt((raw * raw).sum(axis=1))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cosine = (raw[a] @ raw[b].T) / (norm[a][:, None] * norm[b][None, :])
        x, y = np.nonzero(cosine >= threshold)
        x, y = a[x], b[y]
        differ = node[x] != node[y]
        x, y = x[differ], y[differ]
        names, number = np.unique(node, return_inverse=True)
        links = np.zeros(len(names), np.int64)
        np.add.at(links, number[x], weight[y])
        root = names[_forest(number[x], number[y], len(names))]
        found = (links > 0) | (root != names)
        return pa.table({"node": names[found], "links": links[found], "root": root[found]})

    found_type = T.StructType([field("node", T.LongType()), field("links", T.LongType()), field("root", T.LongType())])
    found = materialise(blocks.groupBy(*ring, "hi", "oj").applyInArrow(compare, found_type), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    judged = materialise(
        classes.join(links, "node", "left").join(parts, "node", "left").select(
            F.col("label").alias("of"), "dim", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"), "weight",
        ),
        "judged",
    )
    several = judged.filter("n_links > 0").drop("weight")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(several, ["of", "dim", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
