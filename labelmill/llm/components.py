"""Connected components of links, and pairs within large groups, without one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import materialise

# Rows of a group that meet in one task as one side of a block of pairs.
BLOCK_ROWS = 1024


def components(links: DataFrame) -> DataFrame:
    """Union-find over a table of links ``(a, b)``: ``(node, component)`` with the smallest node reachable.

    Each round takes the least label among a node's neighbours and then the label of that label, so the number of
    rounds follows the logarithm of the longest chain. Tables are written to the shared folder between rounds.
    """
    links = materialise(links.select("a", "b"), "links")
    edges = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = materialise(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")), "lower"
        )
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialise(lower.join(jump, "label").select("node", "old", F.col("next").alias("label")), "labels")
        if labels.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")


def in_blocks(rows: DataFrame, group: str, unique: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal each group's rows to blocks, and repeat them so that every two blocks of a group meet.

    Adds ``block`` (the row's own) and ``i <= j``, the pair of blocks that meets: grouping by ``(group, i, j)`` brings
    together any two rows of a group at least once, and never more than two blocks' rows.
    """
    sizes = rows.groupBy(F.col(group).alias("group__")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks__"))
    dealt = rows.join(sizes, F.col(group).eqNullSafe(F.col("group__"))).withColumn("block", F.pmod(F.xxhash64(unique), "blocks__").cast("int"))
    met = dealt.withColumn("other__", F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1)))
    return met.withColumns({"i": F.least("block", "other__"), "j": F.greatest("block", "other__")}).drop("group__", "blocks__", "other__")
