"""Best-fit packing of tokenised documents into sequences.

Every piece of a document is a vector: tokens, documents (1) and attention cost (tokens squared). A sequence has a
capacity in each. Pieces are placed in decreasing order of size, each into the open sequence that fits it under every
constraint and is best by the weighted rule: the least norm of what remains (``norm``), or the largest dot product of
the piece with what remains (``dot``). Weights follow scarcity: the dimension that needs most sequences counts most.

Full pieces are sequences of their own. The others are dealt at random into groups of a bounded size that are packed
independently; a group loses less than one sequence or two, whatever the size of the table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.bpe_words import word_table
from labelmill.llm.common import shipped, slices, texts, tidied
from labelmill.session import materialise

# Pieces that are packed together.
GROUP_PIECES = 20_000

# Bytes of text whose words are looked up together.
CUT_BYTES = 1 << 20

# How strongly a scarcer dimension outweighs the others.
SCARCITY = 8


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, pieces, and attention cost (sum of squared lengths; None: as long as the tokens fit)."""

    tokens: int = 2048
    documents: int = 2048
    cost: int | None = None

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost or self.tokens**2], float)

    @property
    def longest(self) -> int:
        """Length of a full piece."""
        return min(self.tokens, math.isqrt(int(self.vector[2])))


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, packed in one task."""
    full = capacity.vector
    n = len(lengths)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1) / full
    needed = demand.sum(axis=0)
    weight = (needed / needed.max()) ** SCARCITY if n else needed
    order = np.lexsort((np.arange(n), -(demand @ weight)))
    least = demand.min(axis=0) if n else demand
    room = np.empty((max(n, 1), 3))
    name = np.empty(max(n, 1), np.int64)  # of each open sequence
    used = np.zeros(max(n, 1), np.int64)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    opened = active = 0
    tolerance = 1e-12
    for step, item in enumerate(order):
        d = demand[item]
        at = -1
        if active:
            r = room[:active]
            fits = (r >= d - tolerance).all(axis=1)
            if rule == "norm":
                rest = r - d
                score = np.where(fits, (rest * rest) @ weight, np.inf)
                at = int(score.argmin())
            else:
                score = np.where(fits, -((r * d) @ weight), np.inf)
                at = int(score.argmin())
            at = at if fits[at] else -1
        if at < 0:
            at = active
            room[at], name[at] = 1.0, opened
            active, opened = active + 1, opened + 1
        sequence[item] = s = name[at]
        offset[item] = used[s]
        used[s] += lengths[item]
        room[at] -= d
        if step % 128 == 127:  # sequences that can't hold even the smallest piece are closed
            open_ = np.flatnonzero((room[:active] >= least - tolerance).all(axis=1))
            room[: len(open_)], name[: len(open_)] = room[open_], name[open_]
            active = len(open_)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise documents, add ``end_id`` and cut those longer than a sequence.

    Returns ``(doc_id, piece, start, length, ids_crc32, row[, ids])``. Of a cut document the first piece is the short
    one. A null text is empty: one piece of one id. ``row`` numbers the pieces (not without gaps).
    """
    longest = capacity.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer_file)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, size=CUT_BYTES):
            found, bounds = table.encode([t or b"" for t in texts(batch)])
            whole = np.insert(found, bounds[1:], end_id).astype("<u4")
            ends = bounds[1:] + np.arange(1, len(bounds))
            raw = memoryview(whole.tobytes())
            doc, piece, starts, lengths, crcs, kept = [], [], [], [], [], []
            begin = 0
            for i, end in enumerate(ends.tolist()):
                n = end - begin
                start, nth = 0, 0
                stop = n % longest or min(longest, n)
                while start < n:
                    doc.append(i)
                    piece.append(nth)
                    starts.append(start)
                    lengths.append(stop - start)
                    crcs.append(zlib.crc32(raw[4 * (begin + start) : 4 * (begin + stop)]))
                    if with_ids:
                        kept.append(whole[begin + start : begin + stop].astype("<i4"))
                    start, stop, nth = stop, stop + longest, nth + 1
                begin = end
            rows = np.arange(row, row + len(doc))
            row += len(doc)
            arrays = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(rows)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    long, field = T.LongType(), T.StructField
    schema = [docs.schema["doc_id"], field("piece", T.IntegerType()), field("start", long), field("length", long), field("ids_crc32", long), field("row", long)]
    schema += [field("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return shipped(docs.select("doc_id", "text")).mapInArrow(tidied(cut), T.StructType(schema))


def pack(items: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with ``row`` (unique) and ``length``.

    No sequence exceeds its capacity in any dimension, and pieces lie in it side by side from 0. A piece that fills a
    sequence by itself needs no packing. An empty table gives an empty one.
    """
    items = items.withColumn("row", F.col("row"))
    alone = F.col("length") >= capacity.longest
    rest = items.filter(~alone)
    groups = max(1, -(-rest.count() // group_pieces))
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, table: pa.Table) -> pa.Table:
        rows, lengths = table["row"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(rows)  # the result doesn't depend on the order of arrival
        sequence, offset = best_fit(lengths[order], capacity, rule)
        return pa.table({"row": rows[order], "sequence_id": (key[0].as_py() << 32) + sequence, "offset": offset})

    # A partition a group: partitions of few rows would be joined, but the work of a group follows its square.
    dealt = shipped(rest.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))).repartition(groups, "group")
    placed = dealt.groupBy("group").applyInArrow(place, out)
    single = items.filter(alone).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("bigint")})
    return rest.join(placed, "row").select(*items.columns, "sequence_id", "offset").unionByName(single)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), rule: str = "norm", end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack documents: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row per piece.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Repeated rows are packed as often as they come.
    """
    stored = materialise(pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    return pack(stored, capacity, rule).drop("row")


def sequences(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), rule: str = "norm", end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, input_ids, lengths)``, ``lengths`` those of the pieces in order."""
    stored = materialise(pieces(docs, tokenizer_file, capacity, end_id, with_ids=True), "pieces")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pack(stored, capacity, rule).groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.length").alias("lengths")
    )
