"""Sampling, splitting and batching without moving whole rows.

Random order is ``md5("<seed>:<row id>")`` with the row id as tie-break: it does
not depend on partitioning and can be reproduced by any SQL engine. Exact sample
sizes come from *rank thresholds*: a histogram over the leading digits of the
hash locates the bucket that holds the wanted rank, only that bucket is ranked,
and the data itself is then filtered in place against the threshold. No window
ever spans a whole class, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.session import bounded, local_copy

# Hash digits per histogram step: 4096 buckets, so that counting them shuffles little.
BUCKET_DIGITS = 3

# A bucket with more rows than this is divided once more before it is ranked.
RANK_ROWS = 1_000_000


def hash_key(row_id: Column | str, seed: int = 42) -> Column:
    """Pseudo-random sort key of a row."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def hash_int(key: Column) -> Column:
    """Pseudo-random integer in [0, 2**32) from a text key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def rank_thresholds(
    df: DataFrame, targets: DataFrame, row_id: str = "row_id", seed: int = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """The row at each wanted rank of each group, in hash order.

    ``df`` needs ``grp`` and the row id; ``targets`` has ``(grp, k, rank)`` with ranks
    counted from 1. Returns ``(grp, k, cut_hash, cut_id)``. Targets of rank 0 or beyond
    the group's size have no row.
    """
    keyed = df.select("grp", F.col(row_id).alias("cut_id"), hash_key(row_id, seed).alias("cut_hash"))
    wanted, is_small, width = targets.withColumn("bucket", F.lit("")), True, 0
    while True:
        rows = keyed.withColumn("parent", F.substring("cut_hash", 1, width))
        if width:
            parents = wanted.select("grp", F.col("bucket").alias("parent")).distinct()
            rows = rows.join(parents, ["grp", "parent"], "left_semi")
        width += digits
        histogram = rows.groupBy("grp", "parent", F.substring("cut_hash", 1, width).alias("bucket")).agg(
            F.count("*").alias("n")
        )
        upto = W.partitionBy("grp", "parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        bounds = histogram.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
        held = (
            bounds.join(wanted.select("grp", "k", "rank", F.col("bucket").alias("parent")), ["grp", "parent"])
            .filter((F.col("lo") < F.col("rank")) & (F.col("rank") <= F.col("hi")))
            .select("grp", "bucket", "k", (F.col("rank") - F.col("lo")).alias("rank"), "n")
        )
        wanted, is_small = bounded(held)
        sizes = wanted.select("n") if is_small else wanted.agg(F.max("n"))
        largest = max((r[0] or 0 for r in sizes.collect()), default=0)
        if largest <= RANK_ROWS or width >= 30:
            break
    in_bucket = keyed.withColumn("bucket", F.substring("cut_hash", 1, width)).join(
        wanted.select("grp", "bucket").distinct(), ["grp", "bucket"], "left_semi"
    )
    order = W.partitionBy("grp", "bucket").orderBy("cut_hash", "cut_id")
    ranked = in_bucket.withColumn("rank", F.row_number().over(order))
    cuts = ranked.join(wanted, ["grp", "bucket", "rank"]).select("grp", "k", "cut_hash", "cut_id")
    # At most one row per wanted rank.
    return local_copy(cuts) if is_small else bounded(cuts)[0]


def rows_by_id(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The rows with the given ids; Spark broadcasts the ids if they are few."""
    return df.join(ids.select(row_id), row_id, "left_semi").select(*df.columns)


def _at_or_before(row_id: str, seed: int) -> Column:
    key = hash_key(row_id, seed)
    return (key < F.col("cut_hash")) | ((key == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id")))


def first_by_hash(
    df: DataFrame, group: Column, quota: DataFrame, row_id: str = "row_id", seed: int = 42
) -> DataFrame:
    """Exactly ``rank`` rows of each group, by hash order.

    ``quota`` is ``(grp, rank)``; groups that are absent or have quota 0 yield nothing,
    and quotas beyond the group's size yield the whole group.
    """
    grouped = df.withColumn("grp", group)
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    targets = (
        quota.join(sizes, "grp")
        .select("grp", F.lit(0).alias("k"), F.least("rank", "size").cast("bigint").alias("rank"))
        .filter(F.col("rank") > 0)
    )
    cuts = rank_thresholds(grouped.select("grp", row_id), targets, row_id, seed).drop("k")
    return grouped.join(cuts, "grp").filter(_at_or_before(row_id, seed)).select(*df.columns)


def _up_to(cut, row_id: str, seed: int) -> Column:
    """Rows at or before one threshold; without a threshold there are none."""
    if cut is None:
        return F.lit(False)
    key = hash_key(row_id, seed)
    return (key < cut["cut_hash"]) | ((key == cut["cut_hash"]) & (F.col(row_id) <= cut["cut_id"]))


def sample_n(df: DataFrame, n: int = 20_000, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Seeded sample of exactly ``min(n, rows)`` rows, chosen on ids alone."""
    target = df.agg(F.lit(1).alias("grp"), F.lit(0).alias("k"), F.least(F.lit(n), F.count("*")).alias("rank"))
    cut = rank_thresholds(df.select(F.lit(1).alias("grp"), row_id), target, row_id, seed).first()
    return df.filter(_up_to(cut, row_id, seed))


def shuffle(df: DataFrame, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """All rows in pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(hash_key(row_id, seed), row_id)


def preview(df: DataFrame, n: int = 3, row_id: str = "row_id") -> DataFrame:
    """First rows in row order."""
    return rows_by_id(df, df.select(row_id).orderBy(row_id).limit(n), row_id).orderBy(row_id)


def balance(
    df: DataFrame, max_samples: int | None = None, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Down-sample two classes to equal size; tables without exactly two classes pass unchanged.

    Each class keeps ``min(smallest class, max_samples // 2)`` rows, where a missing
    ``max_samples`` stands for the number of rows.
    """
    counts = df.groupBy(F.col(label).alias("grp")).agg(F.count("*").alias("n"))
    # Two rows at most matter here: one total over the per-class counts, no window over data.
    total = counts.agg(F.min("n").alias("least"), F.sum("n").alias("rows"), F.count("*").alias("classes"))
    half = F.floor(F.lit(max_samples) / 2) if max_samples else F.floor(F.col("rows") / 2)
    per_class = total.select(F.when(F.col("classes") == 2, F.least("least", half))).scalar()
    # A null quota means "not two classes": keep every row.
    quota = counts.select("grp", F.coalesce(per_class, F.col("n")).alias("rank"))
    return first_by_hash(df, F.col(label), quota, row_id, seed)


def split_validation(df: DataFrame, share: float = 0.2, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Mark exactly ``ceil(share * rows)`` rows as validation in the column ``is_validation``."""
    rows = df.agg(F.lit(1).alias("grp"), F.lit(0).alias("k"), F.ceil(F.count("*") * share).alias("rank"))
    cut = rank_thresholds(df.select(F.lit(1).alias("grp"), row_id), rows, row_id, seed)
    return df.withColumn("is_validation", _up_to(cut.first(), row_id, seed))


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Assign ``fold`` 0..k-1 so that every class is spread evenly: ``floor((rank - 1) * k / size)``.

    The last rank of fold ``j`` in a class of ``m`` rows is ``floor(((j + 1) * m + k - 1) / k)``; a row's
    fold is the number of those thresholds that lie before it.
    """
    sizes = df.groupBy(F.col(label).alias("grp")).agg(F.count("*").alias("m"))
    targets = sizes.select("grp", "m", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("k")).select(
        "grp", "k", F.expr(f"(k * m + {k} - 1) div {k}").alias("rank")
    )
    cuts = rank_thresholds(df.select(F.col(label).alias("grp"), row_id), targets, row_id, seed)
    # k - 1 thresholds per class, in one row per class.
    per_class, _ = bounded(cuts.groupBy("grp").agg(F.collect_list(F.struct("cut_hash", "cut_id")).alias("cuts")))
    key = F.struct(hash_key(row_id, seed).alias("cut_hash"), F.col(row_id).alias("cut_id"))
    return (
        df.join(per_class.withColumnRenamed("grp", "_class"), F.col(label) == F.col("_class"), "left")
        .withColumn("_key", key)
        .withColumn(
            "fold",
            F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("_key"))), F.lit(0)).cast("int"),
        )
        .drop("_class", "_key", "cuts")
    )


def profile_sample(df: DataFrame, label: str, n: int = 10, keep: int = 8, row_id: str = "row_id") -> DataFrame:
    """A few rows of each of the first ten labels, in order of first appearance; at most ``keep`` rows.

    A single label falls back to the first ``n`` rows. The per-label limit is a constant,
    so Spark prunes ids to it inside each partition before it shuffles (window group limit).
    """
    narrow = df.filter(F.col(label).isNotNull()).select(row_id, F.col(label).alias("_label"))
    labels = narrow.groupBy("_label").agg(F.min(row_id).alias("first_id"))
    classes = labels.count()
    if classes <= 1:
        return preview(df, min(n, keep), row_id)
    each = max(2, n // min(classes, 10))
    ranked = narrow.withColumn("_rn", F.row_number().over(W.partitionBy("_label").orderBy(row_id)))
    ids = (
        ranked.filter(F.col("_rn") <= each)
        .join(labels.orderBy("first_id").limit(10), "_label")
        .orderBy("first_id", row_id)
        .limit(keep)
    )
    return rows_by_id(df, ids, row_id)


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows together, marked by ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
