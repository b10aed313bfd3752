"""Multi-label rows made by combining single-label texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.text import ellipsis, unquote
from labelmill.operators.sampling import hash_int, hash_key, sample_n
from labelmill.session import bounded, listed

# Shares of kept, two-label and three-label rows, and the length at which three-label texts are cut.
SINGLE_SHARE, PAIR_SHARE, TRIPLE_SHARE = 0.5, 0.3, 0.2
TRIPLE_LENGTH = 400

# Hash digits per bucket when rows are numbered: 65536 buckets per class.
_INDEX_DIGITS = 4


def class_index(df: DataFrame, label: str = "label", row_id: str = "row_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Dense position of every row within its class, and the class sizes.

    Positions follow hash order. A row's position is the number of rows in earlier hash buckets of its
    class plus its rank inside the bucket, so no window holds more than one bucket of a class.
    """
    keyed = df.select(
        F.col(label).cast("string").alias("label"), F.col(row_id).alias("src_id"), hash_key(row_id, seed).alias("h")
    ).withColumn("bucket", F.substring("h", 1, _INDEX_DIGITS))
    histogram = keyed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("label").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = histogram.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("label", "bucket").orderBy("h", "src_id"))
    index = (
        keyed.withColumn("rank", rank)
        .join(offsets.select("label", "bucket", "offset"), ["label", "bucket"])
        .select("label", "src_id", (F.col("offset") + F.col("rank") - 1).alias("idx"))
    )
    return index, bounded(histogram.groupBy("label").agg(F.sum("n").alias("size")))[0]


def draw_classes(spark, n: int, k: int, labels: list[str], seed: int) -> DataFrame:
    """``n`` draws of ``k`` distinct classes: ``(kind, i, pos, label, key)``."""
    choices = F.array(*map(F.lit, labels))
    draw = lambda l: F.struct(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("i").cast("string"), F.lit(":"), l)).alias("h"), l.alias("label"))
    picked = F.slice(F.sort_array(F.transform(choices, draw)), 1, k)
    return (
        spark.range(n)
        .withColumnRenamed("id", "i")
        .select("i", F.posexplode(picked).alias("pos", "c"))
        .select(
            F.lit(k).alias("kind"),
            "i",
            "pos",
            F.col("c.label").alias("label"),
            F.concat(F.lit(f"{seed}:text:{k}:"), F.col("i").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("key"),
        )
    )


def synthesise_multilabel(
    df: DataFrame,
    labels: list[str] | None = None,
    seed: int = 42,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
) -> DataFrame:
    """Half the rows as they are, then 30 % two-class and 20 % three-class combinations.

    Returns ``(kind, seq, text, label)`` with ``kind`` the number of labels. Classes are drawn
    without replacement, texts with replacement. Draws that name a class without texts are skipped. The classes
    are a setting of the draws; more than ``MOST_LABELS`` raise.
    The look-up of a drawn text runs on ids; the texts are joined once, by row id.
    """
    spark = df.sparkSession
    source = df.select(
        F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")
    )
    n = source.count()
    if labels is None:
        labels = sorted(listed(source.select("label").filter("label IS NOT NULL").distinct()))
    kept = sample_n(source, int(n * SINGLE_SHARE), seed).select(
        F.lit(1).alias("kind"), F.col("row_id").cast("bigint").alias("seq"), unquote(F.col("text")).alias("text"), "label"
    )
    parts = [(k, int(n * share)) for k, share in ((2, PAIR_SHARE), (3, TRIPLE_SHARE)) if len(labels) >= k]
    if not parts:
        return kept
    index, sizes = class_index(source.filter(F.col("label").isNotNull()), seed=seed)
    draws = reduce(DataFrame.unionByName, [draw_classes(spark, m, k, labels, seed) for k, m in parts])
    wanted = draws.join(sizes, "label").withColumn("idx", hash_int(F.col("key")) % F.col("size"))
    located = wanted.join(index, ["label", "idx"]).select("kind", "i", "pos", "label", "src_id")
    texts = source.select(F.col("row_id").alias("src_id"), unquote(F.col("text")).alias("text"))
    combined = (
        located.join(texts, "src_id")
        .groupBy("kind", "i")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "label", "text"))).alias("parts"))  # two or three parts
        .filter(F.size("parts") == F.col("kind"))
        .select(
            "kind",
            F.col("i").alias("seq"),
            F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"),
            F.array_join(F.transform("parts", lambda p: p["label"]), ",").alias("label"),
        )
    )
    cut = F.when(F.col("kind") == 3, ellipsis(F.col("text"), TRIPLE_LENGTH)).otherwise(F.col("text"))
    return kept.unionByName(combined.withColumn("text", cut))
