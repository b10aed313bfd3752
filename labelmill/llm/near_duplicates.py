"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash draws for every element a random permutation of the signature's places and a random number per step; the
element offers ``step + number`` to the place of each step. Steps are correlated over the places (each element offers
one rank to each), which lowers the variance below that of independent minima. Values of step ``j`` lie in
``[j, j + 1)``, so once all places are filled later steps can't change them, and the work stops: long documents need
one step or two.

Texts with equal sets are one class and stand for each other. Classes that share a band's key are compared with the
least class of that key first; classes of one key that are still apart after that are compared with each other, in
blocks. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import shipped, sieve, slices, texts, tidied
from labelmill.llm.components import components, in_blocks
from labelmill.llm.words import BASE, CHUNK_BYTES, FACTOR, mixed, words_of
from labelmill.session import materialise

SHINGLE_WORDS = 5

# A pair at similarity 0.75 shares no band with probability (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
PLACES = BANDS * ROWS

# Pairs whose signatures agree in fewer places are not confirmed: five deviations below 0.75.
LEAST_AGREEING = 0.6

# Finer signatures for classes of one band key in different components, of which there can be many that are nearly
# similar enough; 0.69 of 1000 places is more than four deviations below 0.75.
FINE_PLACES = 1000
FINE_AGREEING = 0.69
FINE_ELEMENTS = 10_000

# Bytes of text that are signed together: each shingle has its own order of the places meanwhile.
SIGN_BYTES = CHUNK_BYTES // 2

LINK_PERCENT = 75
def shingle_sets(batch: list[bytes], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (fewer words: one hash of them all; none: empty)."""
    _, hashes, _, _, bounds = words_of(batch)
    runs = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        runs += hashes[k : k + len(runs)] * FACTOR[k]
    runs = mixed(runs)
    sets, first = [], 0
    for last in bounds[1:].tolist():
        n = last - first
        if n >= words:
            sets.append(np.unique(runs[first : last - words + 1]))
        elif n:
            short = (hashes[first:last] * FACTOR[:n]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mixed(short + FACTOR[32 + n]))
        else:
            sets.append(np.empty(0, np.uint64))
        first = last
    return sets


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of nonempty sets, one row each; an empty set keeps infinities."""
    signature = np.full(len(sets) * places, np.inf)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    steps = BASE * (2 * np.arange(places, dtype=np.uint64) + np.uint64(1))
    for step in range(places):
        if not len(element):
            break
        draw = mixed(element + steps[step])
        number = (draw >> np.uint64(11)) * 2.0**-53
        chosen = step + (mixed(draw + BASE) % np.uint64(places - step)).astype(np.int64)
        row = np.arange(len(element))
        if order is None:
            place = chosen
        else:
            place = order[row, chosen].astype(np.int64)
            order[row, chosen] = order[:, step]
        np.minimum.at(signature, owner * places + place, step + number)
        # Values of later steps are larger: a full signature is done.
        open_ = np.isinf(signature.reshape(-1, places)).any(axis=1)[owner]
        if order is None:
            element, owner, chosen = element[open_], owner[open_], chosen[open_]
            order = np.tile(np.arange(places, dtype=np.uint16 if places > 256 else np.uint8), (len(element), 1))
            order[np.arange(len(element)), chosen] = 0
        elif not open_.all():
            element, owner, order = element[open_], owner[open_], order[open_]
    return signature.reshape(-1, places)


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, low)`` of each text: band keys and the low bytes of its signature.

    ``digest`` names the set: texts with equal sets have equal digests. Without words it is null.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SIGN_BYTES):
            sets = shingle_sets([t or b"" for t in texts(batch)])
            bits = super_minhash(sets).view(np.uint64)
            keys = np.zeros((len(sets), BANDS), np.uint64)
            for k in range(ROWS):
                keys += bits.reshape(-1, BANDS, ROWS)[:, :, k] * FACTOR[k]
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * BASE).view(np.int64)
            low = _low_bytes(bits)
            filled = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, filled, strict=True)], pa.binary()),
                    pa.array([k if f else None for k, f in zip(keys, filled, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if f else None for x, f in zip(low, filled, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "low"],
            )

    field = T.StructField
    schema = T.StructType([
        docs.schema["doc_id"], field("n_shingles", T.LongType()), field("digest", T.BinaryType()),
        field("bands", T.ArrayType(T.LongType())), field("low", T.BinaryType()),
    ])
    return shipped(docs.select("doc_id", "text")).mapInArrow(tidied(sign), schema)


def _alike(n1: np.ndarray, low1: np.ndarray, n2: np.ndarray, low2: np.ndarray) -> np.ndarray:
    """Whether sizes allow a link and signatures suggest one."""
    sizes = 100 * np.minimum(n1, n2) >= LINK_PERCENT * np.maximum(n1, n2)
    return sizes & ((low1 == low2).mean(axis=-1) >= LEAST_AGREEING)


def _matrix(column: pa.ChunkedArray | pa.Array, places: int = PLACES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, places)


def _low_bytes(signature: np.ndarray) -> np.ndarray:
    return (mixed(signature.view(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs ``(a, b)`` those whose signatures agree enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            ok = _alike(n1, _matrix(batch.column("low1")), n2, _matrix(batch.column("low2")))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("low").alias("low1"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("low").alias("low2"))
    return shipped(pairs.join(one, "a").join(two, "b")).mapInArrow(keep, pairs.schema)


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, set)`` of the given documents, written once for all that follows; ``docs`` may hold others."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=CHUNK_BYTES):
            found = [s.tobytes() for s in shingle_sets([t or b"" for t in texts(batch)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["node", "set"])

    wanted = nodes.select(F.col("node").alias("doc_id")).hint("shuffle_hash")
    rows = shipped(docs.select("doc_id", "text")).join(wanted, "doc_id", "left_semi")
    return materialise(rows.mapInArrow(tidied(sets), "node bigint, set binary"), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of pairs ``(a, b)`` of ids those whose full sets are similar enough; only sets of these ids are shuffled."""
    pairs = materialise(pairs, "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for s1, s2 in zip(batch.column("set1"), batch.column("set2"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (s1, s2))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= LINK_PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (
        full.filter(sieve(pairs.select(c))(F.col("node"))).select(F.col("node").alias(c), F.col("set").alias(s))
        for c, s in (("a", "set1"), ("b", "set2"))
    )
    return shipped(pairs.join(one, "a").join(two, "b")).mapInArrow(compare, pairs.schema)


def _fine(full: DataFrame) -> DataFrame:
    """``(node, fine)``: low bytes of longer signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set", 8 * FINE_ELEMENTS):
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
            fine = [x.tobytes() for x in _low_bytes(super_minhash(sets, FINE_PLACES))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fine, pa.binary())], ["node", "fine"])

    return shipped(full).mapInArrow(tidied(sign), "node bigint, fine binary")


def _across(members: DataFrame) -> DataFrame:
    """Promising pairs of classes of one band key that are in different components so far.

    ``members`` may be dealt to blocks already, by ``in_blocks(members, "key", "node")``, before they carry signatures.
    """

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, part, n = (table[c].to_numpy() for c in ("node", "part", "n"))
        low, fine, block = _matrix(table["low"]), _matrix(table["fine"], FINE_PLACES), table["block"].to_numpy()
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        i, j, band = key[1].as_py(), key[2].as_py(), table["band"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in left:
            ys = right[part[right] != part[x]]
            ys = ys[node[ys] > node[x]] if i == j else ys
            if len(ys):
                ys = ys[_alike(n[x], low[x], n[ys], low[ys])]
                # Classes that share several bands' keys are compared in the first of them.
                ys = ys[(bands[x] == bands[ys]).argmax(axis=1) == band]
                ys = ys[(fine[x] == fine[ys]).mean(axis=1) >= FINE_AGREEING]
                found += [(node[x], node[y]) for y in ys]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = members if "block" in members.columns else in_blocks(members, "key", "node")
    return shipped(dealt).groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents by links: ``(doc_id, n_shingles, component_id, kept)``, one row per row.

    Two documents are linked when the sets of their five-word shingles (A-Z lower-cased; fewer words: the whole
    sequence) have a Jaccard similarity of 0.75 or more. A text that is null or has no words is linked with nothing.
    ``doc_id`` must be a bigint; rows with a null id link with nothing, their component is null and they are kept.
    Rows with equal ids are one document. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = materialise(signatures(docs), "signatures")
    filled = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    copies = materialise(
        filled.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies"
    )
    copied = sieve(copies.select("digest"))(F.col("digest"))
    least = filled.filter(copied).join(copies, "digest", "left").filter("first IS NULL OR first = doc_id").select(filled.columns)
    classes = materialise(
        filled.filter(~copied).unionByName(least).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "low"), "classes"
    )
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = materialise(keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").drop("last"), "shared")
    members = materialise(keys.join(shared, "key"), "members")
    star = members.filter("node > b").select(F.col("node").alias("a"), "b").distinct()
    meets = sieve(members.select("node"))
    full = _full_sets(docs.filter(meets(F.col("doc_id"))), members.select("node").distinct())
    links = materialise(_confirmed(_promising(star, classes.filter(meets(F.col("node")))), full), "links")
    parts = components(links)
    # Classes of one key that are still apart.
    split = members.join(parts, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("part"))
    split = materialise(split, "split")
    mixed_keys = split.groupBy("key").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).filter("p1 < p2").select("key")
    apart = materialise(split.join(mixed_keys, "key"), "apart")
    meets = sieve(apart.select("node"))(F.col("node"))
    fine = materialise(_fine(full.filter(meets).join(apart.select("node").distinct(), "node", "left_semi")), "fine")
    # Dealt to blocks first: signatures are shuffled once, to where they are compared.
    apart = in_blocks(apart, "key", "node").join(classes.filter(meets).select("node", "n", "low", "bands").join(fine, "node"), "node")
    more = materialise(_confirmed(_across(apart), full), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    every = (
        signed.select("doc_id", "n_shingles", "digest").join(copies, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("node"))
        .join(parts, "node", "left")
    )
    component = F.coalesce("component", "node")
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without all but the one with the smallest id of each near-duplicate group; columns as they are.

    Of rows with the same id one stays (rows without an id all stay).
    """
    judged = near_duplicates(docs)
    gone = materialise(judged.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = materialise(
        judged.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated"
    )
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
