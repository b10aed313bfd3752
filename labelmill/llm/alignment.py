"""Alignment of two tokenizers' tokens over the bytes of a text.

**Cuts from spans.** Both libraries give the span of each token in the text: the byte-level tokenizer in characters, the
sentencepiece model in bytes (the ``proto`` of current releases, ``immutable_proto`` of earlier ones). Where a span
ends at the next one's start, it is a cut. Inside a cell between two such cuts, tokens share characters (a character of
several bytes, or bytes that stand for a character the model doesn't know); there the bytes that the tokens decode to
say where each ends. Decoded bytes are also held against the text as a whole.

**Units.** The words of :mod:`labelmill.llm.bpe_words` are encoded independently by the byte-level tokenizer. The model
encodes them independently, too, where it has no piece with such neighbours; its vocabulary tells for which kinds of
neighbours that is so, and only there a text is cut into units. The alignment of each distinct unit is kept in a table,
bounded in size, that the tasks of a worker share.

**Counts.** Pairs of ids that are linked in a document are counted over all documents. The most frequent pairs, as
many as a share of all allows, are held by every task; the others are joined.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.bpe_codec import pieces
from labelmill.llm.bpe_words import KIND, gather, special_strings, words
from labelmill.llm.common import shipped, slices, texts
from labelmill.llm.tokens import load
from labelmill.session import materialise

# Bytes of text in a slice, new units that are joined to one text, such texts that are aligned together, and units (each
# counted with its bytes / 100) that a worker's table may hold.
SLICE_BYTES = 1 << 20
JOINED_UNITS = 100
JOINED_TEXTS = 20
TABLE_UNITS = 500_000

# Pairs of documents that are unpacked together.
TOGETHER = 500_000

# A pair is frequent if it has this share of all (document, pair) rows; so there are at most a million.
FREQUENT = 1e-6

# How the model writes a space, and what units are joined by: neither tokenizer joins it to anything.
_META, _BETWEEN = "▁", "\n"


def _byte_ends(starts: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte end of each token: its span's stop where the next span starts there, and decoded lengths in between."""
    last = len(stops) - 1
    sure = stops > starts
    sure[:-1] &= stops[:-1] <= starts[1:]
    sure[last] = True
    upto = np.cumsum(lengths)
    cuts = np.flatnonzero(sure)
    cell = np.searchsorted(cuts, np.arange(len(stops)))  # the cut that closes each token's cell
    begin = np.concatenate(([0], stops[cuts]))[cell]
    before = np.concatenate(([0], upto[cuts]))[cell]
    return np.where(sure, stops, begin + upto - before)


class Aligner:
    """Alignments of units by two tokenizers, and a bounded table of them."""

    def __init__(self, a_file: str, b_file: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(load(a_file).to_str())  # an own one, because it is set up differently
        self.a.encode_special_tokens = True
        special_strings(self.a)
        self.b = load_pieces(b_file)
        self.a_bytes = pieces(a_file).to_pylist()
        self.b_bytes = [_piece_bytes(self.b, i) for i in range(self.b.get_piece_size())]
        self.a_lengths, self.b_lengths = (np.array([len(p) for p in x]) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        self.never = np.zeros(64, bool)
        for i, piece in enumerate(self.b_bytes):
            if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i):
                if _BETWEEN.encode() in piece:
                    raise ValueError("the model has pieces with line breaks")
                kind = KIND[np.frombuffer(piece, np.uint8)]
                self.never[kind[:-1] * 8 + kind[1:]] = True
        self.clear()

    def clear(self) -> None:
        self.held = 0.0
        self.index: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((4, 0), np.int32)  # of each unit: A tokens, B tokens, groups, and 1 if the bytes differ
        self.link_ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)  # slices in which each unit was met

    def _tokens(self, text: str) -> tuple[list[int], np.ndarray, list[int], np.ndarray, int] | None:
        """Ids and byte ends of the tokens of space and text by both, and the bytes; None if the bytes of either aren't the text's."""
        whole = " " + text
        raw = whole.encode()
        encoding = self.a.encode(whole, add_special_tokens=False)
        a, proto = encoding.ids, self.b.encode(text, return_type="proto").pieces
        b = [p.id for p in proto]
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(raw) != len(whole):
            code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
            at = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
            spans = at[spans]
        a_ends = _byte_ends(spans[:, 0], spans[:, 1], self.a_lengths[a])
        # The model adds the space itself: its spans are those of the text without it. Each begins where the last ends.
        stops = np.fromiter([p.end for p in proto], np.int64, len(b)) + 1
        b_ends = _byte_ends(np.concatenate(([0], stops[:-1])), stops, self.b_lengths[b])
        if a_ends[-1] != len(raw) or b_ends[-1] != len(raw) or (np.diff(a_ends) <= 0).any() or (np.diff(b_ends) <= 0).any():
            raise ValueError(f"the libraries' spans don't fit the bytes of {text[:80]!r}")
        return a, a_ends, b, b_ends, len(raw)

    def _learn(self, joined: list[list[bytes]], lead: str = "a" + _BETWEEN) -> list[list[bytes]]:
        """Align units of several texts that begin with ``lead``; returns those of texts whose bytes differ."""
        failed, kept, sides, stops, lengths, at = [], [], [], [], [], 0
        for units in joined:
            found = self._tokens(lead + _BETWEEN.join([u.decode() for u in units]))
            if found is None:
                failed.append(units)
                continue
            a, a_ends, b, b_ends, n = found
            sides.append((a, a_ends + at, b, b_ends + at))
            size = np.array([len(u) for u in units])
            lengths.append(size)
            stops.append(at + len(lead) + np.cumsum(size + 1))
            kept += units
            at += n
        if not kept:
            return failed
        a, a_ends, b, b_ends = (np.concatenate(x) for x in zip(*sides, strict=True))
        stops = np.concatenate(stops)
        starts = stops - np.concatenate(lengths)
        marks = np.zeros((4, at + 1), bool)
        marks[0, a_ends], marks[1, b_ends] = True, True
        marks[2], marks[3] = marks[0] & marks[1], marks[0] | marks[1]
        if not (marks[2, stops].all() and marks[2, starts].all()):
            raise ValueError("a token reaches over the end of a unit")
        upto = np.cumsum(marks, axis=1, dtype=np.int32)  # ends of A, B, both and either up to each byte
        common, union = np.flatnonzero(marks[2]), np.flatnonzero(marks[3])
        # Between two neighbouring ends lies the overlap of exactly one A token and one B token.
        links = a[upto[0, union - 1]] * self.width + b[upto[1, union - 1]]
        first, last = upto[:, starts], upto[:, stops]
        a_cuts, b_cuts = [0, *upto[0, common].tolist()], [0, *upto[1, common].tolist()]
        a_names, b_names = list(map(str, a.tolist())), list(map(str, b.tolist()))
        written = [
            f"{a_names[i] if j == i + 1 else ','.join(a_names[i:j])}|{b_names[k] if m == k + 1 else ','.join(b_names[k:m])}"
            for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:], strict=False)
        ]
        groups = [written[i] if j == i + 1 else ";".join(written[i:j]) for i, j in zip(first[2].tolist(), last[2].tolist(), strict=True)]
        n = (last - first).astype(np.int64)
        self._add(kept, groups, n[:3], gather(links, first[3].astype(np.int64), n[3]), np.cumsum(n[3]))
        return failed

    def _add(self, units: list[bytes], groups: list[str], counts: np.ndarray, links: np.ndarray, link_ends: np.ndarray, bad: bool = False) -> None:
        first = len(self.groups)
        self.index.update(zip(units, range(first, first + len(units)), strict=True))
        self.groups += groups
        self._new.append((np.vstack([counts, np.full(len(units), bad)]), links, link_ends))
        self.held += len(units) + sum(map(len, units)) / 100

    def shrink(self) -> None:
        """Keep the units that were met in more than one slice, if these are less than half of the table, or else none."""
        kept = np.flatnonzero(self.uses > 1)
        if 2 * len(kept) > len(self.uses):
            return self.clear()
        names, n = list(self.index), np.diff(self.link_ends)[kept]
        links, groups, counts = gather(self.links, self.link_ends[kept], n), [self.groups[i] for i in kept.tolist()], self.counts[:, kept]
        self.clear()
        self._new = []
        for i in kept.tolist():
            self.held += len(names[i]) / 100
        self.index = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.held += len(kept)
        self.groups, self.counts, self.links = groups, counts, links
        self.link_ends, self.uses = np.concatenate(([0], np.cumsum(n))), np.ones(len(kept), np.int32)
        return None

    def learn(self, new: list[bytes]) -> None:
        """Put units that it doesn't hold into the table."""
        plain, odd = [], []
        for u in new:
            t = u.decode()
            free = not t[0].isspace() or (t[0] == " " and len(t) > 1 and not t[1].isspace())
            (plain if free and not t[-1].isspace() and _META not in t else odd).append(u)
        self._new: list[tuple] = []
        joined = [plain[i : i + JOINED_UNITS] for i in range(0, len(plain), JOINED_UNITS)]
        for i in range(0, len(joined), JOINED_TEXTS):
            odd += chain.from_iterable(self._learn(joined[i : i + JOINED_TEXTS]))
        for u in odd:  # white space at an end would join that of the text around it
            if self._learn([[u]], "a" if u[:1] in b" \t\n\r" else "a" + _BETWEEN):
                self._add([u], [""], np.zeros((3, 1), int), np.zeros(0, np.int64), np.zeros(1, np.int64), True)
        if self._new:
            counts, links, ends = zip(*self._new, strict=True)
            self.counts = np.hstack([self.counts, *counts]).astype(np.int32)
            shift = np.cumsum([self.link_ends[-1], *map(len, links)])
            self.link_ends = np.concatenate([self.link_ends, *(e + s for e, s in zip(ends, shift, strict=False))])
            self.links = np.concatenate([self.links, *links])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.groups) - len(self.uses), np.int32)])

    def align(self, batch: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: A tokens, B tokens, groups and links as rows of an array; the groups as text; and for all texts
        the links as sorted (text, pair) with the number of times, and where each text's begin and end."""
        if self.held > TABLE_UNITS:
            self.shrink()
        found, bounds = words([b" " + t if t else b"" for t in batch], None, self.never)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([u for u in distinct if u not in self.index])
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        self.uses[number] += 1
        number = number[coded.indices.to_numpy()]
        begins, ends = bounds[:-1], bounds[1:]
        n_links = np.diff(self.link_ends)[number]
        totals = np.vstack([self.counts[:, number], n_links])
        upto = np.hstack([np.zeros((5, 1), np.int64), np.cumsum(totals, axis=1)])
        sums = upto[:, ends] - upto[:, begins]
        good = sums[3] == 0
        sums = np.where(good, sums[[0, 1, 2, 4]], 0)
        held = [";".join(map(self.groups.__getitem__, number[i:j].tolist())) if g else "" for i, j, g in zip(begins, ends, good, strict=True)]
        # The links of all units of good texts, each with its text's number.
        text = np.repeat(np.arange(len(batch)), ends - begins)
        kept = good[text] if len(text) else np.zeros(0, bool)
        number, text, n_links = number[kept], text[kept], n_links[kept]
        stops = np.cumsum(n_links)
        place = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.link_ends[number] - stops + n_links, n_links)
        span = len(self.a_bytes) * self.width
        pair, times = np.unique(np.repeat(text, n_links) * span + self.links[place], return_counts=True)
        bounds = np.searchsorted(pair, np.arange(len(batch) + 1) * span)
        return sums, held, pair % span, times, bounds


@lru_cache(maxsize=4)
def load_pieces(path: str):
    """The sentencepiece model of a file, once per process."""
    from sentencepiece import SentencePieceProcessor

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return SentencePieceProcessor(model_file=path)


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_META, " ").encode()


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner a process, so that the tasks of a worker share its table."""
    return Aligner(a_file, b_file)


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs and their times as compressed planes of bytes of the differences."""
    steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(steps.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 12 * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8")[:, 0]
    return np.cumsum(steps.astype(np.int64)), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``TOGETHER`` pairs."""
    for batch in batches:
        upto, first = np.cumsum(batch["n_pairs"].to_numpy()), 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
            yield batch.slice(first, last - first)
            first = last


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Aligned tokens of every whole text: ``(doc_id, n_a, n_b, n_groups, n_links, groups, n_pairs, pairs)``, a row per row.

    A encodes space and text, B the text (it adds the space itself), both without special tokens. ``groups`` writes the
    ids between two common ends as ``a,a|b;a|b,b``; a link is a pair of an A and a B token that share a byte; ``pairs``
    packs the distinct linked id pairs for :func:`score_links`. Texts that are null or empty, or whose tokens don't join
    to space and text, have no tokens. ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_file, b_file)
        for batch in slices(batches, size=SLICE_BYTES):
            sums, groups, pairs, times, bounds = both.align([t or b"" for t in texts(batch)])
            packed = [_packed(pairs[i:j], times[i:j]) for i, j in pairwise(bounds.tolist())]
            arrays = [batch["doc_id"], *map(pa.array, sums.astype(np.int64)), pa.array(groups, pa.string()), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    long, field = T.LongType(), T.StructField
    counts = [field(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([docs.schema["doc_id"], *counts, field("groups", T.StringType()), field("n_pairs", long), field("pairs", T.BinaryType())])
    return shipped(docs.select("doc_id", "text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Documents that hold each linked pair, and whether no other pair of its A id is in more: ``(pair, n, best)``."""
    width = load_pieces(b_file).get_piece_size()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = [_unpacked(p, n)[0] for p, n in zip(batch["pairs"].to_pylist(), batch["n_pairs"].to_pylist(), strict=True)]
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    counted = shipped(aligned.select("n_pairs", "pairs")).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("a", F.call_function("div", F.col("pair"), F.lit(width))), "pairs")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, a_file: str, b_file: str, frequent: float = FREQUENT) -> DataFrame:
    """Rows of :func:`align` with ``n_best`` and ``count_sum`` in place of ``pairs`` and ``n_pairs``.

    ``n_best`` counts the links whose pair is in most documents of all pairs of its A id (ties included), ``count_sum``
    adds over the links the number of documents that hold their pair. Other columns stay.
    """
    spark = aligned.sparkSession
    stored = materialise(aligned.withColumn("row__", F.monotonically_increasing_id()), "aligned")
    table = materialise(pair_counts(stored, a_file, b_file), "pair_counts")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = table.filter(F.col("n") >= frequent * total).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast([known[c].to_numpy().copy() for c in ("pair", "n", "best")])

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of all links of a batch: row number, pair, times, place among the frequent pairs, and whether it is there."""
        n = batch["n_pairs"].to_numpy()
        found = [_unpacked(p, k) for p, k in zip(batch["pairs"].to_pylist(), n.tolist(), strict=True)]
        pair, times = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        pairs = held.value[0]
        place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        there = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
        return np.repeat(np.arange(len(n)), n), pair, times, place, there

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            row, _, times, place, there = looked_up(batch)
            row, times, place = row[there], times[there], place[there]
            # Whole numbers: the products are added as such, not in floating point.
            out = []
            for value in (held.value[2][place].astype(np.int64), held.value[1][place]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, times * value)
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([batch["row__"], *out], ["row__", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            row, pair, times, _, there = looked_up(batch)
            rest = np.flatnonzero(~there)
            rows = batch["row__"].take(pa.array(row[rest]))
            yield pa.RecordBatch.from_arrays([rows, pa.array(pair[rest]), pa.array(times[rest])], ["row__", "pair", "times"])

    links = shipped(stored.select("row__", "n_pairs", "pairs"))
    asked = links.mapInArrow(others, "row__ bigint, pair bigint, times bigint").join(table, "pair")
    rare = asked.select("row__", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    scored = links.mapInArrow(sums, "row__ bigint, n_best bigint, count_sum bigint").unionByName(rare)
    scored = scored.groupBy("row__").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.drop("n_pairs", "pairs").join(scored, "row__").drop("row__")
