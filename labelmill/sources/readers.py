"""Readers for user files: CSV, JSON, JSON lines, plain text, labelled tables and predictions."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.functions.replies import one_json_value
from labelmill.functions.text import strip
from labelmill.session import local_copy
from labelmill.sources.csv_records import read_records
from labelmill.sources.json_lists import as_input, first_signs, lists_as_lines

_CORRUPT = "_corrupt_record"


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows in file order.

    Ids follow the splits of the scan, so write the table before relying on them across runs.
    """
    return df.select(F.monotonically_increasing_id().alias(name), "*")


def probe_text(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding of a CSV file, and whether its records may span lines.

    The text source hands over raw bytes, so one distributed scan can check every line: all valid
    means UTF-8, otherwise ISO-8859-1, which decodes any byte. A quoted field with a line break
    begins with a quote at the start of a field that isn't closed on its line; a quote elsewhere in
    an unquoted field means nothing. Without such lines the file can be read in splits.
    """
    # Closed quoted fields are taken out first; what still opens a field with a quote is not closed. Possessive
    # quantifiers keep the matcher from recursing over long fields.
    closed = F.regexp_replace("value", r'(^|[,\t])[ ]*+"[^"]*+(?:""[^"]*+)*+"(?=[,\t]|\s*$)', "$1")
    row = (
        spark.read.text(path)
        .agg(
            F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)),
            F.coalesce(F.bool_or(closed.rlike(r'(^|[,\t])[ ]*"')), F.lit(False)),
        )
        .first()
    )
    return ("UTF-8" if row[0] else "ISO-8859-1"), row[1]


def detect_separator(spark: SparkSession, path: str) -> str:
    """Tab if the header line has tabs and no comma, else comma."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"no data in {path}")
    return "\t" if "\t" in header[0] and "," not in header[0] else ","


def read_csv_any(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV or TSV with a header, in UTF-8 or Latin-1, read in splits also where records span lines."""
    separator = detect_separator(spark, path)
    encoding, multiline = probe_text(spark, path)
    if multiline:
        return read_records(spark, path, separator, encoding, infer)
    return spark.read.csv(
        path, header=True, inferSchema=infer, encoding=encoding, sep=separator, escape='"'
    )


_JSON = {"allowSingleQuotes": "false"}


def _json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """The valid lines of JSON-lines files as rows; None if there are none."""
    lines = spark.read.text(paths).select(strip(F.col("value")).alias("line"))
    valid = lines.filter((F.col("line") != "") & F.col("line").rlike(r"^\{") & one_json_value(F.col("line")))
    schema = spark.read.json(paths, columnNameOfCorruptRecord=_CORRUPT, allowSingleQuotes=False).schema
    schema = StructType([f for f in schema if f.name != _CORRUPT])
    if not schema.fields:
        return None
    return valid.select(F.from_json("line", schema, _JSON).alias("row")).select("row.*")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; invalid lines are skipped, and a file without valid lines is an error."""
    df = _json_lines(spark, path)
    if df is None:
        raise ValueError(f"no valid JSON objects in {path}")
    return df


def count_invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """Number of non-blank lines that are not JSON."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).filter(F.col("line") != "")
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(~one_json_value(F.col("line"))).alias("n_invalid"))


def _files(df: DataFrame, condition) -> list[str]:
    return [r["file"] for r in df.filter(condition).select("file").collect()]


def read_json_any(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold a list of objects, an object of equally long lists, a single object, or JSON lines.

    Each file is judged by itself. A file that is one list is read in splits. Of the others, a file whose first line is a
    JSON value and that has more lines is JSON lines; any other is one object if it parses as a whole (one row, and so
    one task per file), and else JSON lines with damaged ones. The driver holds the names of the files, as for any scan.
    """
    line = strip(F.col("value"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    every = first_signs(spark, path)
    in_lists, elements = lists_as_lines(spark, path, every)
    listed = set(in_lists)
    rest = [f for f, sign in every.items() if sign is not None and f not in listed]
    by_line, objects, others = [], [], []
    if rest:
        lines = spark.read.text(as_input(path, rest, every)).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), place.alias("place"))
        kinds = (
            lines.filter(F.col("line") != "").groupBy("file")
            .agg(
                F.count("*").alias("n"), F.min_by(one_json_value(F.col("line")), "place").alias("first_whole"),
                F.min_by(F.col("line").startswith("{"), "place").alias("object"),
            )
        )
        for r in kinds.collect():  # a row per file; a file of one line is that line
            (others if r["n"] > 1 and not r["first_whole"] else objects if r["n"] == 1 and r["first_whole"] and r["object"] else by_line).append(r["file"])
    if not by_line and not objects and not others and not in_lists:
        raise ValueError(f"no data in {path}")
    if others:
        whole = spark.read.text(as_input(path, others, every), wholetext=True).select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
        judged = local_copy(whole.select("file", (one_json_value(F.col("line")) & F.col("line").startswith("{")).alias("ok")))
        objects += _files(judged, "ok")
        by_line += _files(judged, "NOT ok")
    parts = []
    if objects:
        df = spark.read.json(as_input(path, objects, every), multiLine=True, allowSingleQuotes=False)
        parts.append(_by_column(df) if all(t.startswith("array") for _, t in df.dtypes) else df)
    for paths in (as_input(path, by_line, every) if by_line else [], [elements] if elements else []):
        if paths and (rows := _json_lines(spark, paths)) is not None:
            parts.append(rows)
    parts = [p for p in parts if p.columns]
    if not parts:
        raise ValueError(f"no valid JSON objects in {path}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _by_column(df: DataFrame) -> DataFrame:
    """Rows of objects that hold a list for each column."""
    zipped = F.arrays_zip(*df.columns)
    for c in df.columns[1:]:
        same = F.size(df.columns[0]) == F.size(c)
        zipped = F.when(same, zipped).otherwise(F.raise_error(F.lit("columns differ in length")))
    return df.select(F.inline(zipped))


def parse_txt_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines to ``(text, label)``: tab, else the last comma, else no label. Blank lines are skipped."""
    line = strip(F.col(value))
    kept = lines.withColumn("_line", line).filter(F.col("_line") != "")
    tab = F.contains("_line", F.lit("\t"))
    comma = F.contains("_line", F.lit(",")) & ~F.col("_line").startswith('"')
    fields = F.split("_line", "\t")
    last = F.substring_index("_line", ",", -1)
    before = F.expr("left(_line, length(_line) - length(substring_index(_line, ',', -1)) - 1)")
    return kept.select(
        *[c for c in lines.columns if c != value],
        F.when(tab, fields[0]).when(comma, strip(before)).otherwise(F.col("_line")).alias("text"),
        F.when(tab, fields[1]).when(comma, strip(last)).alias("label"),
    )


def read_txt_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text file of labelled lines."""
    return parse_txt_lines(spark.read.text(path))


def load_data(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, str]:
    """Read a user file by its extension (or the given kind); returns the table and the format."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    readers = {"csv": read_csv_any, "json": read_json_any, "jsonl": read_json_lines, "txt": read_txt_labelled}
    if kind not in readers:
        raise ValueError(f"unsupported file format {kind!r}")
    return readers[kind](spark, path), "json" if kind == "jsonl" else kind


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Training or test CSV ``text,label``: malformed lines and rows without text or label are dropped."""
    encoding, multiline = probe_text(spark, path)
    if multiline:
        df = read_records(spark, path, encoding=encoding, names=["text", "label"], drop_malformed=True)
    else:
        df = spark.read.csv(path, schema="text string, label string", header=True, mode="DROPMALFORMED", escape='"', encoding=encoding)
    return df.na.drop(subset=["text", "label"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSV; the columns text, label and predicted_label are required."""
    encoding, multiline = probe_text(spark, path)
    df = read_records(spark, path, encoding=encoding) if multiline else spark.read.csv(path, header=True, escape='"', encoding=encoding)
    missing = {"text", "label", "predicted_label"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}; found {df.columns}")
    return df
