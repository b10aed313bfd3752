"""Session helpers: configuration, shared scratch folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes up to which a lookup table may be held by the driver and broadcast.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20

# Bytes of a batch for a Python task in a session that has no such limit: else it has 10,000 rows, whatever they hold.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

# Labels that may shape a schema, a model or a prompt.
MOST_LABELS = 1000


def local_session(
    cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g", java_options: str = ""
) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", java_options)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there all
    tasks run on the same machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="labelmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/labelmill/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan would otherwise be evaluated again (non-deterministic
    input, or one table feeding several jobs). Unlike a cache, the files
    survive the loss of executors. ``options`` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """Let batches for Python tasks follow ``BATCH_BYTES``, unless the session has a limit."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def local_copy(df: DataFrame) -> DataFrame:
    """A local relation of a table whose size the caller has proven to be small."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def bounded(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """A small side whose size Catalyst knows, and whether it is within ``limit`` rows and ``SMALL_BYTES``.

    The table is computed once, into the shared folder, where its rows are counted and its bytes bounded by
    the widths of its values. A small one becomes a local relation, which Spark broadcasts by its actual size.
    A larger one stays where it is and is joined by shuffle, where adaptive execution splits skewed partitions.
    """
    stored = materialise(df, "bounded")
    width = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    rows, size = stored.agg(F.count("*"), F.coalesce(F.sum(reduce(lambda a, b: a + b, width)), F.lit(0))).first()
    if rows > limit or size > SMALL_BYTES:
        return stored, False
    return local_copy(stored), True


def listed(df: DataFrame, column: str = "label", limit: int = MOST_LABELS) -> list:
    """The values of a one-row-per-value table as a Python list, for settings that hold one entry per value.

    More than ``limit`` values raise: the caller needs a form that keeps them in a table.
    """
    values = [r[0] for r in df.select(column).limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"more than {limit} values in {column!r}; use a table of them or the long form")
    return values
