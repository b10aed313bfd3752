"""Registry of the queries: each has a Spark side and, where SQL can express it, an oracle side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.text import SEQUENCE_FILTERS
from labelmill.operators.sampling import hash_int

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its oracle if it has one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# --- inputs shared by several queries -------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled text: ``(row_id, text, label)`` with the language as label."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the binary quality label."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label")
    )
    return docs(spark, sf_dir).drop("label").join(rows, "row_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a comma-separated label string from quality, toxicity and language."""
    flags = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "row_id")
    label = F.concat_ws(
        ", ", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")
    )
    base = docs(spark, sf_dir).withColumnRenamed("label", "lang")
    return base.join(flags, "row_id").select("row_id", "text", label.alias("label"))


def unit(name: str, id_column: str = "row_id"):
    """Pseudo-random number in [0, 1) of a row."""
    return hash_int(F.concat(F.lit(f"{name}:"), F.col(id_column).cast("string"))) / F.lit(4294967296.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a rule-based language prediction, null for very short texts."""
    n = F.col("n_chars")
    said = (
        F.when(F.col("text").rlike("[äöüß]"), "de")
        .when(F.col("text").rlike("[ñáíó]"), "es")
        .when(F.col("text").rlike("[çèê]"), "fr")
        .when(n >= 100, "en")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"), said.alias("predicted_label")
    )


TAG_LABELS = ["de", "en", "es", "fr", "good", "toxic"]
LANGS = ["de", "en", "es", "fr"]

# --- the same inputs in SQL ------------------------------------------------------------------

WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOCS = "SELECT doc_id AS row_id, text, lang AS label FROM documents"
QUALITY = "SELECT d.doc_id AS row_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
TAGS = (
    "SELECT d.doc_id AS row_id, d.text, concat_ws(', ', CASE WHEN quality = 1 THEN 'good' END, "
    "CASE WHEN toxic = 1 THEN 'toxic' END, lang) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)
PREDICTIONS = (
    "SELECT doc_id AS row_id, text, lang AS label, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' "
    "WHEN regexp_matches(text, '[ñáíó]') THEN 'es' WHEN regexp_matches(text, '[çèê]') THEN 'fr' "
    "WHEN n_chars >= 100 THEN 'en' END AS predicted_label FROM documents"
)
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
SEQUENCE = (
    f"list_filter(string_split(translate(lower(text), '{SEQUENCE_FILTERS}', '{' ' * len(SEQUENCE_FILTERS)}'), ' '), "
    "lambda x: x <> '')"
)


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def sql_key(row_id: str = "row_id", seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({row_id} AS VARCHAR))"


def sql_int(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT)"


def sql_unit(name: str, row_id: str = "row_id") -> str:
    return sql_int(f"'{name}:' || CAST({row_id} AS VARCHAR)") + " / 4294967296.0"
