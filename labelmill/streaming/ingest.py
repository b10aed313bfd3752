"""Incremental ingest of teacher responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators.replies import parse_samples

RESPONSE_SCHEMA = "seq bigint, class_label string, prompt_type string, response string, status string"


def read_response_stream(spark: SparkSession, in_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Responses arriving as JSON-line files."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(in_dir)


def stream_samples(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int | None = None
) -> StreamingQuery:
    """Parse responses as they arrive and append their samples to a Parquet table.

    Stateless, so no watermark; the checkpoint makes restarts continue where they stopped,
    and the file sink's commit log keeps the output free of repeats.
    """
    samples = parse_samples(read_response_stream(spark, in_dir, files_per_trigger))
    rows = samples.select("seq", "pos", "text", F.col("class_label").alias("label"))
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out_dir)
    )
