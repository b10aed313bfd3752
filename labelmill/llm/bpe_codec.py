"""BPE encoding by a table of distinct words, and decoding by a table of pieces.

Texts are split into words (:mod:`labelmill.llm.bpe_words`), each distinct word is encoded once, and its ids come back
to every place of the word.

Words that are frequent in a sample of the texts are few, whatever the texts are: every task holds their ids, so no
frequent word is a hot key. All other words are joined. Each chunk of texts asks for its other words; the questions meet
by word, where the word is encoded; the answers meet the chunk's draft, which holds the number of each of its words.
Chunks are of one size, so no text and no group of copies makes a task larger than others. The sample decides only
which words travel, never what an id is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelmill.llm.bpe_words import gather, special_strings, words
from labelmill.llm.common import shipped, slices, texts
from labelmill.llm.tokens import load
from labelmill.session import materialise

# A word of eight bytes is frequent if it is this share of all words, a longer one in proportion to its bytes and
# eight more. So all frequent words together have at most 16 / share bytes (160 MB).
FREQUENT = 1e-7

# Share of the rows in which frequent words are looked for.
SAMPLE = 0.125

# Bytes of text in a chunk, ids that are decoded together, and words that are encoded together.
CHUNK_BYTES = 2 << 20
DECODED_IDS = 1 << 20
_TOGETHER = 20_000


def _utf8(docs: DataFrame) -> DataFrame:
    return shipped(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _word_ids(tokenizer, distinct: pa.Array) -> pa.Array:
    """The ids of each word of an array of distinct words."""
    found = []
    for start in range(0, len(distinct), _TOGETHER):
        plain = [w.decode() for w in distinct.slice(start, _TOGETHER).to_pylist()]
        found += [e.ids for e in tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
    return pa.array(found, pa.list_(pa.int32()))


def frequent_words(docs: DataFrame, tokenizer_file: str, frequent: float = FREQUENT, sample: float = SAMPLE) -> pa.Table:
    """The frequent words of a sample, the most frequent first, with their ids: ``(word, ids)``, bounded in bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = special_strings(load(tokenizer_file))
        for batch in slices(batches, size=CHUNK_BYTES):
            found = words(texts(batch), special)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("ids", _word_ids(load(tokenizer_file), batch["word"]))

    counted = _utf8(docs).sample(sample, seed=1).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counted.filter(F.col("n") * 16.0 / (F.octet_length("word") + 8) >= frequent * total)
    table = kept.mapInArrow(encoded, "word binary, n bigint, ids array<int>").toArrow()
    return table.sort_by([("n", "descending")]).select(["word", "ids"]).combine_chunks()


def encode(docs: DataFrame, tokenizer_file: str, frequent: float = FREQUENT, sample: float = SAMPLE) -> DataFrame:
    """Token ids of every whole text, as the tokenizers library gives them: ``(doc_id, ids)``, one row per row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. It is read twice after the sample and must give
    the same rows in the same order, as a table in files does (if it doesn't, the job fails). A null text is empty; an
    empty text has no ids. Strings of special tokens inside a text become the special token, as by the library's
    default. Repeated rows come back as often as they came.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, tokenizer_file, frequent, sample))
    width = "<u2" if load(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"
    changed = "the rows of docs were others, or in another order, when they were read again"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
        """For each chunk: its key, the rows, the distinct words that aren't frequent, the number of each word (frequent
        ones first, then these), and the texts' bounds. The key depends on the chunk's place and on these words."""
        special, task = special_strings(load(tokenizer_file)), TaskContext.get().partitionId()
        for nth, batch in enumerate(slices(batches, size=CHUNK_BYTES)):
            found, bounds = words(texts(batch), special)
            coded = found.dictionary_encode()
            number = pc.index_in(coded.dictionary, value_set=known.value["word"])
            other = number.is_null().to_numpy(False)
            number = pc.fill_null(number, 0).to_numpy().astype(np.int64)
            number[other] = known.value.num_rows + np.arange(other.sum())
            asked = coded.dictionary.filter(pa.array(other))
            digest = hashlib.blake2b(b"%d:%d:" % (task, nth) + b"\0".join(asked.to_pylist()), digest_size=8).digest()
            yield int.from_bytes(digest, "little", signed=True), batch, asked, number[coded.indices.to_numpy()], bounds

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, asked, _, _ in chunks(batches):
            n = len(asked)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), asked], ["chunk", "slot", "word"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of sorted words, each encoded once."""
        last, held = None, None
        for batch in batches:
            coded = batch["word"].dictionary_encode()
            new = coded.dictionary
            new = new[1:] if len(new) and new[0].as_py() == last else new
            packed = [np.array(ids, width).tobytes() for ids in _word_ids(load(tokenizer_file), new).to_pylist()]
            packed = packed if len(new) == len(coded.dictionary) else [held, *packed]
            if packed:
                last, held = coded.dictionary[-1].as_py(), packed[-1]
            ids = pa.array(packed, pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["slot"], ids], ["chunk", "slot", "ids"])

    def drafts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch, _, number, bounds in chunks(batches):
            # Planes of bytes: numbers of frequent words are small, so the higher planes are mostly zero.
            planes = number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            row = [key], [batch["doc_id"].to_pylist()], [pa.compress(planes, "zstd", asbytes=True)], [bounds.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(row, to_arrow_schema(draft).types, strict=True)], draft.names)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of a chunk's texts, from the numbers of its words and the ids of all these words."""
        if left.num_rows != 1:
            raise ValueError(changed)
        bounds = left["bounds"].combine_chunks().flatten().to_numpy()
        planes = pa.decompress(left["numbers"][0].as_py(), 4 * int(bounds[-1]), "zstd", asbytes=True)
        number = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)
        own = right.sort_by("slot")["ids"].combine_chunks()
        table = known.value
        if len(number) and number.max() >= table.num_rows + len(own):
            raise ValueError(changed)
        lengths = np.concatenate((pc.list_value_length(table["ids"]).to_numpy(), pc.binary_length(own).to_numpy() // np.dtype(width).itemsize)).astype(np.int64)
        flat = np.concatenate((pc.list_flatten(table["ids"]).to_numpy(), np.frombuffer(own.buffers()[2] or b"", width).astype(np.int32)))
        begins = np.cumsum(lengths) - lengths
        ends = np.concatenate(([0], np.cumsum(lengths[number])))
        ids = gather(flat, begins[number], lengths[number])
        lists = pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.table([left["doc_id"].combine_chunks().flatten(), lists], names=["doc_id", "ids"])

    id_type, field = docs.schema["doc_id"], T.StructField
    draft = T.StructType([
        field("chunk", T.LongType()), field("doc_id", T.ArrayType(id_type.dataType)), field("numbers", T.BinaryType()),
        field("bounds", T.ArrayType(T.IntegerType())),
    ])
    asked = _utf8(docs).mapInArrow(requests, "chunk bigint, slot int, word binary")
    answered = asked.repartition("word").sortWithinPartitions("word").mapInArrow(answers, "chunk bigint, slot int, ids binary")
    drafted = _utf8(docs).mapInArrow(drafts, draft)
    schema = T.StructType([id_type, field("ids", T.ArrayType(T.IntegerType()))])
    return drafted.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(fill, schema)


@lru_cache(maxsize=4)
def pieces(tokenizer_file: str) -> pa.Array:
    """Bytes of every id, by id. A byte-level vocabulary writes each byte as a character of its own."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = load(tokenizer_file).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token)
    return pa.array(out, pa.binary())


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """Texts of token ids: ``(doc_id, ids, text)``, one row per row.

    Each id is joined to its piece by its number in the vocabulary, which every task holds (its size is that of the
    tokenizer's file). Bytes that are no UTF-8 become U+FFFD and ids outside the vocabulary nothing, as in the library.
    Null ids give an empty text. Special tokens are written as their strings.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer_file)
        for whole in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(whole["ids"]), 0).to_numpy(), dtype=np.int64)
            first = 0
            while first < whole.num_rows:
                before = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, before + DECODED_IDS, "right")))
                batch = whole.slice(first, last - first)
                flat = batch["ids"].flatten()
                flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
                found = pc.fill_null(table.take(flat), b"")
                bounds = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy(), dtype=np.int64)))
                bounds = bounds[np.concatenate(([0], upto[first:last] - before))].tolist()
                raw = memoryview(found.buffers()[2] or b"")  # the pieces lie side by side
                decoded = [str(raw[a:b], "utf-8", "replace") for a, b in pairwise(bounds)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(decoded, pa.string())], ["doc_id", "ids", "text"])
                first = last

    schema = T.StructType([encoded.schema["doc_id"], encoded.schema["ids"], T.StructField("text", T.StringType())])
    return shipped(encoded.select("doc_id", "ids")).mapInArrow(join, schema)
