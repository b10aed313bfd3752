"""JSON files that hold one list of objects, read in splits.

The text source cuts a file at every closing brace, so a list without line breaks is read in splits, too. What a brace
means depends on the strings and brackets before it. For either beginning, outside or inside a string, each split reports
how it ends and how brackets raise and lower the depth; composing the reports along a file says how every split begins.
An element ends at a brace that brings the depth back to that of the list, and belongs to the split in which it begins.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import materialise, scratch_path

_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_BRACKETS = re.compile(rb"[\[\]{}]")
_BETWEEN = b", \t\r\n"

# Whether a string is open at the end, depth gained, least depth, and how often the least depth is reached; the least
# depth at the end of a chunk but the last.
_SIDE = "struct<ends: boolean, gain: bigint, low: bigint, hits: bigint, low_end: bigint>"
_REPORT = f"file string, block bigint, opens binary, closes binary, outside {_SIDE}, inside {_SIDE}"

_ARROW_SIDE = pa.struct([("ends", pa.bool_()), *((c, pa.int64()) for c in ("gain", "low", "hits", "low_end"))])
_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("opens", pa.binary()), ("closes", pa.binary()), ("outside", _ARROW_SIDE), ("inside", _ARROW_SIDE),
])


def as_paths(files: list[str]) -> list[str]:
    """Names of files as the scan reports them (with escapes, as in addresses), as paths to read."""
    return list(map(unquote, files))


def as_input(path: str | list[str], chosen: list[str], every: Collection[str]) -> str | list[str]:
    """The path itself if all of its files are chosen, so that Spark lists a folder and not each file by its name."""
    return path if len(chosen) == len(every) else as_paths(chosen)


def _chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The bytes between closing braces, in order, with the file and the beginning of their split."""
    chunks = spark.read.option("lineSep", "}").text(paths)
    return chunks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _step(inside: bool, chunk: bytes) -> tuple[bool, bytes]:
    """Whether a string is open after the bytes, and the brackets outside strings."""
    if inside:
        rest = _REST.match(chunk)
        if rest is None:
            return True, b""
        chunk = chunk[rest.end() :]
    bare = _STRING.sub(b"", chunk) if b'"' in chunk else chunk
    opened = bare.find(b'"')
    return opened >= 0, b"".join(_BRACKETS.findall(bare if opened < 0 else bare[:opened]))


class _Side:
    """What a split does if it begins outside or inside a string. The brace that ends its last chunk is left to the composition."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.low, self.hits, self.low_end = inside, 0, 0, 0, None

    def add(self, chunk: bytes, first: bool) -> None:
        if not first:
            self.brackets(b"}" if not self.inside else b"")
            if not self.inside and (self.low_end is None or self.depth < self.low_end):
                self.low_end = self.depth
        self.inside, found = _step(self.inside, chunk)
        self.brackets(found)

    def brackets(self, found: bytes) -> None:
        for b in found:
            if b in b"[{":
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth < self.low:
                    self.low, self.hits = self.depth, 0
                self.hits += self.depth == self.low

    def row(self) -> dict:
        return {"ends": self.inside, "gain": self.depth, "low": self.low, "hits": self.hits, "low_end": self.low_end}


def split_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per split: its first and last byte that is no white space, and what it does for either beginning."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for batch in batches:
            for file, block, chunk in zip(*(batch[c].to_pylist() for c in ("file", "block", "chunk")), strict=True):
                first = now.get("at") != (file, block)
                if first:
                    if now:
                        yield _report(now)
                    now = {"at": (file, block), "opens": b"", "closes": b"", "sides": (_Side(False), _Side(True))}
                for side in now["sides"]:
                    side.add(chunk, first)
                bare = chunk.strip()
                now["opens"] = now["opens"] or bare[:1]
                now["closes"] = bare[-1:] or now["closes"]
        if now:
            yield _report(now)

    return _chunks(spark, paths).mapInArrow(scanned, _REPORT)


def _report(now: dict) -> pa.RecordBatch:
    outside, inside = (side.row() for side in now["sides"])
    row = {"file": now["at"][0], "block": now["at"][1], "opens": now["opens"], "closes": now["closes"], "outside": outside, "inside": inside}
    return pa.RecordBatch.from_pylist([row], _ARROW)


def begun(reports: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int, int]], dict[str, bool]]:
    """How splits begin that don't begin between two elements, ``(inside a string, depth, split of the element)``, and of
    each file whether it is one list. One row per split is composed along each file."""

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        found, inside, depth, first, good = [], False, 0, None, rows[-1]["closes"] == b"]"
        for i, r in enumerate(rows):
            if first is not None:
                found.append({"file": r["file"], "block": r["block"], "inside": inside, "depth": depth, "first": first, "is_list": None})
            side, last = r["inside" if inside else "outside"], i == len(rows) - 1
            least = depth + side["low"]  # the list's own depth is left once, at the end
            good = good and (least == 0 and side["hits"] == 1 if last else least >= 1 or (least == 0 and not side["hits"]))
            renewed = first is None or (side["low_end"] is not None and depth + side["low_end"] <= 1)
            inside, depth = side["ends"], depth + side["gain"] - (not last and not side["ends"])
            open_ = inside or depth != 1
            first = (r["block"] if renewed else first) if open_ else None
        good = good and not inside and depth == 0
        found.append({"file": rows[0]["file"], "block": None, "inside": None, "depth": None, "first": None, "is_list": good})
        fields = [("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("first", pa.int64()), ("is_list", pa.bool_())]
        return pa.Table.from_pylist(found, pa.schema(fields))

    rows = reports.groupBy("file").applyInArrow(compose, "file string, block bigint, inside boolean, depth bigint, first bigint, is_list boolean").collect()
    starts = {(r["file"], r["block"]): (r["inside"], r["depth"], r["first"]) for r in rows if r["block"] is not None}
    return starts, {r["file"]: r["is_list"] for r in rows if r["block"] is None}


def list_elements(spark: SparkSession, paths: str | list[str], starts: dict[tuple[str, int], tuple[bool, int, int]]) -> DataFrame:
    """The elements of lists of objects as lines of JSON: ``(value)``. An element has to fit a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole elements, and pieces of those that cross splits, under the split in which they begin."""
        at, held, inside, depth, home = None, [], False, 0, None
        for batch in batches:
            out = []
            for file, block, chunk in zip(*(batch[c].to_pylist() for c in ("file", "block", "chunk")), strict=True):
                if (file, block) != at:
                    if held:
                        out.append((at[0], home, at[1], False, b"}".join([*held, b""])))
                    at, held = (file, block), []
                    inside, depth, home = starts.get(at, (False, 0 if block == 0 else 1, None))
                    crossing = home is not None
                if not held and not crossing:
                    home, chunk = block, chunk.lstrip(_BETWEEN)
                    if depth == 0:
                        chunk, depth = chunk.removeprefix(b"[").lstrip(_BETWEEN), 1
                    if chunk[:1] in (b"]", b""):
                        continue
                inside, found = _step(inside, chunk)
                depth += found.count(b"{") + found.count(b"[") - found.count(b"}") - found.count(b"]")
                held.append(chunk)
                if not inside:
                    depth -= 1
                    if depth == 1:
                        out.append((at[0], home, at[1], not crossing, b"}".join([*held, b""])))
                        held, crossing = [], False
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(at[0], home, at[1], False, b"}".join([*held, b""]))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "block", "piece", "whole", "value"])

    found = _chunks(spark, paths).mapInArrow(read, "file string, block bigint, piece bigint, whole boolean, value binary")
    elements = found.filter("whole").select("value")
    if starts:
        pieces = found.filter("NOT whole").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("p"))
        elements = elements.unionByName(pieces.select(F.expr("aggregate(p.value, X'', (a, b) -> concat(a, b))").alias("value")))
    # Line ends within an element lie between its parts: in strings they are written as escapes.
    return elements.select(F.translate(F.decode("value", "UTF-8"), "\r\n", "  ").alias("value"))


def first_signs(spark: SparkSession, path: str | list[str]) -> dict[str, str | None]:
    """The first byte of each file that is no white space (null: none); the driver holds the files' names."""
    chunks = _chunks(spark, path).select("file", F.struct("block", F.monotonically_increasing_id()).alias("place"), F.ltrim(F.translate(F.decode("chunk", "ISO-8859-1"), "\t\r\n", "   ")).alias("c"))
    first = F.min_by(F.substring("c", 1, 1), F.when(F.col("c") != "", F.col("place")))
    return {r["file"]: r["first"] for r in chunks.groupBy("file").agg(first.alias("first")).collect()}


def begin_with_bracket(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files whose first byte that is no white space is an opening bracket."""
    return sorted(f for f, sign in first_signs(spark, path).items() if sign == "[")


def lists_as_lines(spark: SparkSession, path: str | list[str], signs: dict[str, str | None]) -> tuple[list[str], str | None]:
    """The files that hold one list each, and the folder to which their elements were written as JSON lines (None if
    there are no such files)."""
    some = sorted(f for f, sign in signs.items() if sign == "[")
    if not some:
        return [], None
    starts, verdicts = begun(materialise(split_reports(spark, as_input(path, some, signs)), "splits"))
    lists = sorted(f for f, is_list in verdicts.items() if is_list)
    if not lists:
        return [], None
    out = scratch_path(spark, "elements")
    list_elements(spark, as_input(path, lists, signs), {k: v for k, v in starts.items() if verdicts[k[0]]}).write.text(out)
    return lists, out
