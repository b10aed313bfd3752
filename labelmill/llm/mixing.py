"""Mixing sources to target weights, by distributed prefix sums over hash-random order.

Each document gets a random key that depends on its id alone. Within a source the
key's range is cut into buckets of a bounded size; bucket sums and their running
totals give every bucket its place, and only rows of one bucket meet in a task. A
source whose target is k times its size and a rest is taken k times whole, and then
in key order up to exactly the rest, so the last document may be taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.llm.common import WORD
from labelmill.session import materialise

# Rows of a source that are ordered in one task, about.
BUCKET_ROWS = 1_000

# First characters of a source's name that make the ranges in which names are numbered.
PREFIX_CHARS = 6


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(names: DataFrame, column: str) -> DataFrame:
    """Number distinct names from 0 by code point, null last.

    Names are numbered within ranges (their first characters), and ranges are counted first.
    """
    prefix = F.coalesce(F.substring(column, 1, PREFIX_CHARS), F.lit(""))
    ranged = names.withColumn("range", F.struct(F.col(column).isNull().alias("last"), prefix.alias("prefix")))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy(F.col(column).asc_nulls_last())) - 1
    placed = ranged.withColumn("place", place).join(before, "range")
    return placed.withColumn("number", F.col("place") + F.col("before")).drop("range", "place", "before")


def targets(sources: DataFrame, total: int, most: int = 3) -> DataFrame:
    """Share ``total`` by ``weight``, no source above ``most`` times its ``source_size``.

    ``sources`` is ``(source, source_size, weight)``. What capped sources leave is shared by weight among
    the others until none is above. Adds ``target``. Only sums over the sources reach the driver.
    """
    cap, share = F.col("source_size") * most, None
    while True:
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share) >= cap
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")
        ).first()
        new = (total - (row["capped"] or 0)) / row["weights"] if row["weights"] else 0.0
        if new == share or not row["weights"]:
            break
        share = new
    share = share or 0.0
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(share))))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", size: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """How much of every document the mix takes.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored. Sources in order of code points,
    null (a source like any other) last, weigh ``weights`` in turn. ``size`` defaults to the number of words. Returns
    one row per row: ``(doc_id, source, size, source_size, target, taken)``. Rows with equal ids stand side by side in
    the order. Documents of size 0 are taken 0 times; an empty table gives an empty result.
    """
    sized = materialise(
        docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).cast("bigint").alias("size"))
        .withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "sizes",
    )
    totals = materialise(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources"
    )
    row = totals.agg(F.sum("source_size").alias("total")).first()
    ranks = numbered(totals, "source").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    )
    shares = targets(materialise(ranks, "weights"), row["total"] or 0, most).select(
        F.col("source").alias("of"), "source_size", "docs", "target"
    )
    # Whole epochs, then the rest; a rounded target keeps the budget in whole words.
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    placed = (
        sized.join(shares, sized["source"].eqNullSafe(shares["of"])).drop("of")
        .withColumn("bucket", F.floor(unit * F.ceil(F.col("docs") / bucket_rows)))
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    running = W.partitionBy("source").orderBy("bucket")
    before = sums.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"), (F.sum("in_bucket").over(running) - F.col("in_bucket")).alias("before")
    )
    order = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = budget - epochs * F.col("source_size")
    return (
        placed.withColumn("upto", F.sum("size").over(order) - F.col("size"))
        .join(before, placed["source"].eqNullSafe(before["of"]) & (placed["bucket"] == before["at"]))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("upto"))))
            .cast("bigint").alias("taken"),
        )
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken (a partly taken one counts from half its size on).

    Columns are those of ``docs``. ``mixed`` is ``mix(docs)``; documents of size 0 are taken once, as they cost nothing.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    counts = mixed.groupBy("doc_id").agg(F.max(times).alias("times__"))
    joined = docs.join(counts.withColumnRenamed("doc_id", "id__"), F.col("doc_id").eqNullSafe(F.col("id__")))
    epochs = F.expr("CASE WHEN times__ >= 1 THEN sequence(1, times__) ELSE array() END")
    return joined.withColumn("epoch__", F.explode(epochs)).select(*docs.columns)
