"""Duplicate report over normalised texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import ellipsis, key_digest, norm_key
from labelmill.session import materialise

# Fixed value: duplicate rate in percent above which a table is flagged.
DUPLICATE_THRESHOLD = 5.0

_PREFIX = 64


def _groups(df: DataFrame, text: str, *aggs, also: tuple = ()) -> DataFrame:
    """One row per distinct key. A 32-byte digest is grouped in place of the text, and copies combine map-side."""
    return df.groupBy(key_digest(F.col(text)).alias("digest"), *also).agg(F.count("*").alias("n"), *aggs)


def duplicate_report(df: DataFrame, threshold: float = DUPLICATE_THRESHOLD, text: str = "text") -> DataFrame:
    """Rows, distinct rows, duplicates, rate in percent (2 places) and whether the unrounded rate exceeds the threshold."""
    counts = _groups(df, text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("uniq"))
    rate = F.when(F.col("total") > 0, (F.col("total") - F.col("uniq")) / F.col("total") * 100).otherwise(F.lit(0.0))
    return counts.select(
        F.col("total").alias("total_samples"),
        F.col("uniq").alias("unique_samples"),
        (F.col("total") - F.col("uniq")).alias("duplicate_count"),
        F.round(rate, 2).alias("duplicate_rate"),
        F.lit(float(threshold)).alias("threshold"),
        (rate > threshold).alias("exceeds_threshold"),
    )


def duplicate_warning(report: DataFrame, dataset: str = "training") -> DataFrame:
    """The report row if its rate exceeds the threshold, else nothing."""
    return report.filter("exceeds_threshold").withColumn("dataset", F.lit(dataset))


def duplicate_examples(df: DataFrame, k: int = 3, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """The first ``k`` duplicate groups in key order: first text (100 characters) and group size.

    Groups carry the first 64 characters of their key. The k-th smallest prefix bounds the
    candidates, ties included; only the candidates' first rows are looked up for the full key.
    """
    key = norm_key(F.col(text))
    # The prefix follows from the digest; as a grouping column it leaves only numbers to aggregate.
    prefix = F.substring(key, 1, _PREFIX).alias("prefix")
    # Written once: the groups are aggregated over all texts, and both branches below read the few that repeat.
    copies = materialise(_groups(df, text, F.min(row_id).alias("first_id"), also=(prefix,)).filter(F.col("n") > 1), "copies")
    bound = copies.orderBy("prefix", "first_id").limit(k).agg(F.max("prefix")).scalar()
    candidates = copies.filter(F.col("prefix") <= bound).select("first_id", "n")
    return (
        df.join(candidates, F.col(row_id) == F.col("first_id"))
        .select(key.alias("_key"), ellipsis(F.col(text), 100).alias("example"), F.col("n").alias("copies"))
        .orderBy("_key")
        .limit(k)
        .select("example", "copies")
    )
