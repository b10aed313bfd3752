"""Writers for prepared tables, samples, response logs, feature tables and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.profile import analysis_report
from labelmill.sources.batches import append_batch, read_batches


def _csv(df: DataFrame, path: str, mode: str, escape: str = '"') -> None:
    df.write.mode(mode).csv(
        path, header=True, escape=escape, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8"
    )


def save_dataset(
    df: DataFrame, path: str, clean: bool = False, fmt: str = "parquet", decision: dict | None = None
) -> str:
    """Write a prepared table and, next to it, its analysis report; returns the report's path.

    Parquet is the default (splittable, typed); CSV escapes with a backslash if the text was cleaned.
    """
    if fmt == "csv":
        _csv(df, path, "overwrite", "\\" if clean else '"')
    else:
        df.write.mode("overwrite").parquet(path)
    report = f"{path.rstrip('/')}_analysis_report"
    analysis_report(df, decision).write.mode("overwrite").json(report)
    return report


def append_samples(df: DataFrame, path: str, fmt: str = "parquet", batch: str | None = None) -> bool:
    """Append accepted samples ``(text, label)``; each CSV part carries the header.

    With ``batch`` the samples are published under that name once (see ``sources.batches``): a repeated append does
    nothing and returns false. Read such a table by ``read_samples``, and append to it by batches only.
    """
    rows = df.select("text", "label")
    if batch is not None:
        options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if fmt == "csv" else {}
        return append_batch(rows, path, batch, fmt, **options)
    if fmt == "csv":
        _csv(rows, path, "append")
    else:
        rows.write.mode("append").parquet(path)
    return True


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Samples of the published batches."""
    options = {"header": True, "escape": '"', "multiLine": True} if fmt == "csv" else {}
    return read_batches(spark, path, "text string, label string", fmt, **options)


def log_responses(results: DataFrame, path: str, model: str = "teacher", batch: str | None = None) -> bool:
    """Append raw responses with a timestamp, partitioned so that later reads prune by type and status.

    With ``batch`` they are published under that name once, as in ``append_samples``.
    """
    rows = results.withColumn("logged_at", F.current_timestamp()).withColumn("model_used", F.lit(model))
    if batch is not None:
        return append_batch(rows, path, batch, "json", ("prompt_type", "status"))
    rows.write.partitionBy("prompt_type", "status").mode("append").json(path)
    return True


_RESPONSES = (
    "seq bigint, batch bigint, class_label string, prompt string, response string, logged_at timestamp, "
    "model_used string, error string, prompt_type string, status string"
)


def read_responses(spark: SparkSession, path: str, batches: bool = False) -> DataFrame:
    """Read a response log; one written by batches with ``batches=True``."""
    return read_batches(spark, path, _RESPONSES, "json") if batches else spark.read.schema(_RESPONSES).json(path)


def save_features(path: str, vocab: DataFrame, stats: DataFrame | None = None, labels: DataFrame | None = None) -> None:
    """Write vocabulary, feature statistics and label index as small Parquet tables."""
    for name, table in (("vocabulary", vocab), ("stats", stats), ("labels", labels)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_features(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Read the vocabulary back; the feature dimension is its size."""
    vocab = spark.read.parquet(f"{path}/vocabulary")
    return vocab, vocab.count()


def save_predictions(df: DataFrame, path: str) -> None:
    """Write a scored table as CSV."""
    _csv(df, path, "overwrite")
