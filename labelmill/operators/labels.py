"""Label standardisation, encoding and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.text import first_label as first_label_of
from labelmill.functions.text import multi_hot as multi_hot_of
from labelmill.functions.text import split_labels
from labelmill.operators.profile import individual_labels
from labelmill.session import bounded, listed, materialise


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; the table has {df.columns}")


def binary_mapping(df: DataFrame, label: str, order: str = "first_seen", row_id: str = "row_id") -> DataFrame:
    """``(value, code)`` of the first two labels, by first appearance or sorted."""
    seen = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("value")).agg(F.min(row_id).alias("first_id"))
    if order not in ("first_seen", "sorted"):
        raise ValueError(f"unknown order {order!r}")
    key = "first_id" if order == "first_seen" else "value"
    two = seen.orderBy(key).limit(2)
    return two.select("value", (F.row_number().over(W.orderBy(key)) - 1).alias("code"))


def to_binary(
    df: DataFrame, text: str = "text", label: str = "label", order: str = "first_seen", row_id: str = "row_id"
) -> DataFrame:
    """Text and 0/1 label; labels beyond the first two become 0."""
    _need(df, text, label)
    codes = binary_mapping(df, label, order, row_id).toDF("_value", "_code")
    # Two rows at most.
    return df.join(F.broadcast(codes), F.col(label) == F.col("_value"), "left").select(
        row_id,
        F.col(text).cast("string").alias("text"),
        F.when(F.col(label).isNotNull(), F.coalesce("_code", F.lit(0))).cast("int").alias("label"),
    )


def to_multiclass(df: DataFrame, text: str = "text", label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Text and string label."""
    _need(df, text, label)
    return df.select(row_id, F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))


def to_multilabel(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    labels: list[str] | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Text, one 0/1 column ``label_<x>`` per distinct label, and the original label string.

    The label list shapes the schema, so it is read first unless given. More than ``MOST_LABELS`` raise: for
    them use :func:`to_label_array` or :func:`long_labels`.
    """
    _need(df, text, label)
    if labels is None:
        labels = listed(individual_labels(df, label))
    parts = split_labels(F.col(label).cast("string"))
    return df.select(
        row_id,
        F.col(text).cast("string").alias("text"),
        *[F.array_contains(parts, x).cast("int").alias(f"label_{x}") for x in labels],
        F.col(label).cast("string").alias("label"),
    )


def to_label_array(df: DataFrame, text: str = "text", label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Text, the array of distinct labels, and the original label string: for any number of labels."""
    _need(df, text, label)
    value = F.col(label).cast("string")
    return df.select(row_id, F.col(text).cast("string").alias("text"), F.array_distinct(split_labels(value)).alias("labels"), value.alias("label"))


def folded_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """What a binary mapping folds: one row with the number of labels, and rows that are in neither of the first two by count."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label)).agg(F.count("*").alias("n"))
    two = counts.orderBy(F.desc("n")).limit(2).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return counts.agg(F.count("*").alias("n_labels"), (F.coalesce(F.sum("n"), F.lit(0)) - two).alias("n_beyond_two"))


def long_labels(df: DataFrame, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """One row per row and distinct label."""
    return df.select(row_id, F.explode(F.array_distinct(split_labels(F.col(label).cast("string")))).alias("label"))


def to_single_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep the first part of a multi-label string."""
    return df.withColumn(label, first_label_of(F.col(label).cast("string")))


def multi_hot(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Add ``y``, the 0/1 vector over ``labels``."""
    return df.withColumn("y", multi_hot_of(F.col(label).cast("string"), labels))


def drop_empty(df: DataFrame, cleaned: bool = False, text: str = "text", label: str = "label") -> DataFrame:
    """Drop rows without text or label; after cleaning also rows whose text became empty."""
    kept = df.na.drop(subset=[text, label])
    return kept.filter(F.length(text) > 0) if cleaned else kept


def filter_labels(df: DataFrame, labels: list[str] | DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is allowed; the list may be Python values or a one-column table."""
    if isinstance(labels, DataFrame):
        return df.join(labels.select(F.col(labels.columns[0]).alias(label)), label, "left_semi").select(*df.columns)
    return df.filter(F.col(label).isin(list(labels)))


def label_index(train: DataFrame, label: str = "label") -> DataFrame:
    """``(label, idx)`` over the sorted distinct training labels.

    Labels are dealt to ranges, written, and numbered within their range after the ranges' sizes are known.
    """
    distinct = train.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    ranged = materialise(distinct.repartitionByRange("label").select("label", F.spark_partition_id().alias("part")), "labels")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    place = F.row_number().over(W.partitionBy("part").orderBy("label")) - 1
    numbered = ranged.withColumn("place", place).join(before, "part")
    return bounded(numbered.select("label", (F.col("place") + F.col("before")).cast("int").alias("idx")))[0]


def unseen_labels(index: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Test labels that the training table does not have."""
    return test.select(F.col(label).alias("label")).distinct().join(index, "label", "left_anti")


def encode_labels(
    train: DataFrame, test: DataFrame | None = None, label: str = "label"
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Replace labels by their index; a test label unknown to the training table is an error.

    Returns the index table, the encoded training table and the encoded test table.
    """
    index = label_index(train, label)
    if test is not None:
        unknown = [r["label"] for r in unseen_labels(index, test, label).limit(5).collect()]
        if unknown:
            raise ValueError(f"labels not seen in training: {unknown}")
    encode = lambda df: df.join(index.withColumnRenamed("label", "_l"), F.col(label) == F.col("_l")).drop("_l")
    return index, encode(train), None if test is None else encode(test)


def decode_labels(df: DataFrame, index: DataFrame, code: str = "prediction", out: str = "predicted_label") -> DataFrame:
    """Class index back to its label."""
    names = index.select(F.col("idx").alias("_i"), F.col("label").alias(out))
    return df.join(names, F.col(code).cast("int") == F.col("_i"), "left").drop("_i")


def label_coverage(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Configured labels against labels seen: ``(label, configured, seen)``."""
    seen = df.select(F.col(label).cast("string").alias("label")).distinct().withColumn("seen", F.lit(True))
    wanted = labels.select(F.col(labels.columns[0]).alias("label")).distinct().withColumn("configured", F.lit(True))
    return wanted.join(seen, "label", "full_outer").select(
        "label",
        F.coalesce("configured", F.lit(False)).alias("configured"),
        F.coalesce("seen", F.lit(False)).alias("seen"),
    )
