"""Appends that happen once: every batch is written aside and then published under its name by one atomic file.

A table is a folder with ``data/batch_name=<batch>/attempt=<attempt>`` and ``published/<batch>``, a file that names the attempt that counts.
Readers take published attempts only, so a batch that is written twice is there once, and one whose writer died before
publishing is not there at all.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """The published batches of a table, each with the folder of its rows."""
    try:
        files = spark.read.text(f"{path}/published", wholetext=True, pathGlobFilter="*.batch").select(
            F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.batch$", 1).alias("batch"), F.trim("value").alias("attempt")
        )
        return {r["batch"]: f"{path}/data/batch_name={r['batch']}/attempt={r['attempt']}" for r in files.collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def _publish(spark: SparkSession, path: str, batch: str, attempt: str) -> bool:
    """Name the attempt that counts, unless one is named; false if so. The file appears whole or not at all."""
    context, hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop
    folder = hadoop.fs.Path(f"{path}/published")
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    aside, final = hadoop.fs.Path(folder, f"_{batch}.{attempt}"), hadoop.fs.Path(folder, f"{batch}.batch")
    out = system.create(aside, False)
    out.write(attempt.encode())
    out.close()
    files = hadoop.fs.FileContext.getFileContext(system.getUri(), context._jsc.hadoopConfiguration())
    plain = context._gateway.new_array(hadoop.fs.Options.Rename, 0)  # doesn't replace
    try:
        files.rename(system.makeQualified(aside), system.makeQualified(final), plain)
    except Exception:
        if not system.exists(final):
            raise
        system.delete(aside, False)
        return False
    return True


def append_batch(df: DataFrame, path: str, batch: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> bool:
    """Append rows under a batch's name; false, and nothing happens, if that batch is published already.

    Of several writers of one batch the first to publish counts. Names consist of letters, digits, ``.``, ``_`` and ``-``.
    """
    if not _NAME.fullmatch(batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark, path = df.sparkSession, path.rstrip("/")
    if batch in published(spark, path):
        return False
    attempt = uuid.uuid4().hex
    df.write.format(fmt).options(**options).partitionBy(*partition_by).save(f"{path}/data/batch_name={batch}/attempt={attempt}")
    return _publish(spark, path, batch, attempt)


def read_batches(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """All rows of the published batches of a table."""
    folders = sorted(published(spark, path.rstrip("/")).values())
    empty = spark.createDataFrame([], schema)
    if not folders:
        return empty
    rows = spark.read.format(fmt).options(**options).schema(schema).option("basePath", f"{path.rstrip('/')}/data").load(folders)
    return rows.select(*empty.columns)
