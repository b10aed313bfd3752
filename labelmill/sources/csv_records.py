"""Records of CSV files whose quoted fields may hold line breaks, read in splits.

Whether a line break ends a record depends on the quotes before it, back to the start of the file. But a split has only
two ways to begin, between records or inside a quoted field, and each leads to one way it ends. So

1. every split is scanned once and reports how it ends for either beginning,
2. composing these reports along a file, one row per split, says how each split begins, and
3. the splits are read again from there: a record belongs to the split in which it begins.

A record that goes on into other splits is put together from their pieces by its first split. Quotes count as the reader
takes them: a quote opens a field only as its first character, two quotes inside a quoted field are one, and a single
one closes it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import materialise

_PLACE = "file string, block bigint"


def _opens(separator: str) -> re.Pattern:
    """Matches a line, read from the start of a field, that ends inside a quoted field."""
    s = re.escape(separator)
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    return re.compile(rf'(?:(?:{quoted}"[^{s}]*+|(?!")[^{s}]*+){s})*+{quoted}$'.encode(), re.DOTALL)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as bytes with the file and the beginning of the split that they are read from; line feeds end lines."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes], list[bool]]]:
    """Runs of lines of one split, in order, and whether each has a quote. A split may come in several runs."""
    for batch in batches:
        has = pc.match_substring(batch["line"], b'"').to_pylist()
        lines, files, blocks = batch["line"].to_pylist(), batch["file"], batch["block"]
        ends = pa.array(range(1, batch.num_rows + 1))
        if batch.num_rows:
            same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1]))
            stops = [*ends[:-1].filter(pc.invert(same)).to_pylist(), batch.num_rows]
            start = 0
            for stop in stops:
                yield (files[start].as_py(), blocks[start].as_py()), lines[start:stop], has[start:stop]
                start = stop


def split_ends(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """How each split ends: ``(file, block, from_outside, from_inside, through)``.

    ``from_outside`` and ``from_inside`` say, for either beginning, whether it ends inside a quoted field; ``through``
    whether a record that is open at its beginning is still the same at its end.
    """
    opens = _opens(separator)

    def row(at: tuple[str, int], outside: bool, inside: bool, through: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "from_outside": outside, "from_inside": inside, "through": through}])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (False, True, True)
        for split, lines, quoted in _by_split(batches):
            if split != at:
                if at:
                    yield row(at, *state)
                at, state = split, (False, True, True)
            outside, inside, through = state
            for line in (x for x, q in zip(lines, quoted, strict=True) if q):
                after = opens.match(line) is not None, opens.match(b'"' + line) is not None
                outside, inside = after[outside], after[inside]
                through = through and inside
            state = outside, inside, through
        if at:
            yield row(at, *state)

    return _lines(spark, path).mapInArrow(scan, f"{_PLACE}, from_outside boolean, from_inside boolean, through boolean")


def begun_inside(ends: DataFrame) -> dict[tuple[str, int], int]:
    """The splits that begin inside a record, with the split in which that record begins.

    One row per split is composed along each file; only the splits named are gathered, some hundred bytes for each.
    """

    def compose(table: pa.Table) -> pa.Table:
        found, inside, first = [], False, 0
        for r in table.sort_by("block").to_pylist():
            if inside:
                found.append({"file": r["file"], "block": r["block"], "first": first})
            ends_inside = r["from_inside"] if inside else r["from_outside"]
            if ends_inside and not (inside and r["through"]):
                first = r["block"]
            inside = ends_inside
        return pa.Table.from_pylist(found, pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64())]))

    rows = ends.groupBy("file").applyInArrow(compose, f"{_PLACE}, first bigint").collect()
    return {(r["file"], r["block"]): r["first"] for r in rows}


def csv_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """Every record of CSV files as bytes, without its line end: ``(file, block, nth, record)``.

    ``block`` and ``nth`` order the records of a file. Blank records are left out. A field that is still open at the end
    of a file closes there. A record has to fit a row.
    """
    opens = _opens(separator)
    ends = materialise(split_ends(spark, path, separator), "splits")
    inside_at = begun_inside(ends)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and pieces (``nth`` null) of those that cross splits, under the split in which they begin."""
        at, nth, held, inside, lead = None, 0, [], False, False
        for split, lines, quoted in _by_split(batches):
            out = []
            if split != at:
                if held:
                    out.append((at[0], inside_at[at] if lead else at[1], None, at[1], b"\n".join(held)))
                at, nth, held = split, 0, []
                inside = lead = split in inside_at
            for line, q in zip(lines, quoted, strict=True):
                if not inside and not line.rstrip(b"\r"):
                    continue
                if q:
                    inside = opens.match(b'"' + line if inside else line) is not None
                if not held and not inside and not lead:
                    out.append((at[0], at[1], nth, at[1], line))
                    nth += 1
                    continue
                held.append(line)
                if not inside:
                    key = (at[0], inside_at[at], None, at[1]) if lead else (at[0], at[1], nth, at[1])
                    out.append((*key, b"\n".join(held)))
                    nth, held, lead = nth + (not lead), [], False
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(at[0], inside_at[at] if lead else at[1], None, at[1], b"\n".join(held))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "nth", "piece", "record"])

    found = _lines(spark, path).mapInArrow(read, f"{_PLACE}, nth bigint, piece bigint, record binary")
    records = found.filter("nth IS NOT NULL").drop("piece")
    if not ends.filter("from_outside OR from_inside AND NOT through").isEmpty():
        pieces = materialise(found.filter("nth IS NULL"), "pieces")
        # The last record of its split, after all numbered ones; a split begins at most one that leaves it.
        joined = pieces.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("piece", "record"))).alias("p"))
        records = records.unionByName(joined.select("file", "block", F.lit(1 << 62).alias("nth"), _joined("p").alias("record")))
    whole = F.expr("substring(record, 1, octet_length(record) - int(endswith(record, X'0D')))")
    return records.withColumn("record", whole)


def _joined(pieces: str):
    """The pieces' bytes with a line feed between them."""
    return F.expr(f"aggregate(slice({pieces}.record, 2, size({pieces})), {pieces}.record[0], (a, b) -> concat(a, X'0A', b))")


def _named(header: str, separator: str) -> list[str]:
    """Column names of a header record; empty names get a number, and repeated ones have it appended."""
    names = next(csv.reader([header], delimiter=separator))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


# Types of columns in the order in which they are tried, each with the form of its values.
_TYPES = {
    "int": r"^[+-]?\d{1,10}$", "bigint": r"^[+-]?\d{1,19}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "boolean": "(?i)^(true|false)$",
}


def _inferred(df: DataFrame) -> DataFrame:
    """Columns of strings as the first type that takes all their values; one pass for all columns and types."""
    fits = [
        F.bool_and(F.col(c).isNull() | (F.col(c).rlike(form) & F.col(c).try_cast(kind).isNotNull())).alias(f"{i}:{kind}")
        for i, c in enumerate(df.columns) for kind, form in _TYPES.items()
    ]
    found = df.agg(*fits, *[F.count(c).alias(f"{i}:n") for i, c in enumerate(df.columns)]).first()
    kinds = [next((k for k in _TYPES if found[f"{i}:{k}"]), "string") if found[f"{i}:n"] else "string" for i in range(len(df.columns))]
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in zip(df.columns, kinds, strict=True)])


def read_records(
    spark: SparkSession,
    path: str | list[str],
    separator: str = ",",
    encoding: str = "UTF-8",
    infer: bool = False,
    names: list[str] | None = None,
    drop_malformed: bool = False,
) -> DataFrame:
    """CSV files with a header, whose quoted fields may hold line breaks, as columns; in as many tasks as there are splits.

    Missing fields are null and surplus ones are left out, or with ``drop_malformed`` such records are. ``names`` gives
    the columns in place of the header's names.
    """
    records = csv_records(spark, path, separator).withColumn("record", F.decode("record", encoding))
    first = (F.col("block") == 0) & (F.col("nth") == 0)
    header = records.filter(first).select("record").first() or records.select("record").first()
    if header is None:
        raise ValueError(f"no data in {path}")
    names = names or _named(header[0], separator)
    places = [f"c{i}" for i in range(len(names))]
    fields = ", ".join(f"{c} string" for c in [*places, "bad"])
    options = {"sep": separator, "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "bad", "maxCharsPerColumn": "-1"}
    rows = records.filter(~first).select(F.from_csv("record", F.lit(fields), options).alias("r"))
    if drop_malformed:
        rows = rows.filter("r.bad IS NULL")
    df = rows.select(*[F.col(f"r.{c}").alias(n) for c, n in zip(places, names, strict=True)])
    return _inferred(df) if infer else df
