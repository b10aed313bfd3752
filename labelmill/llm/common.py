"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that a Python task takes apart at a time, so that its memory follows this and not the batch.
SLICE_BYTES = 4 << 20

# Bytes of a batch that an executor gathers for a Python task: else it has 10,000 rows, whatever they hold, in the
# executor's memory outside the heap and again in the task's.
BATCH_BYTES, BATCH_SETTING = SLICE_BYTES, "spark.sql.execution.arrow.maxBytesPerBatch"

# Bits of a sieve for each key, and at most in all (4 MB): with more keys it lets more rows through, and misses none.
SIEVE_BITS_A_KEY, SIEVE_BITS = 16, 1 << 25

# Fixed values of the contracts: a word is a run of other characters than these six.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_crc(doc_id: Column | str, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds`` (fold of the empty text for a null id)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        start = total = 0
        for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()):
            if row > start and total + n > size:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives the memory that it no longer needs back to the system, because its worker lives on."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidy


def sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that every value of the one column of ``keys`` passes, and few others: a bitmap of hashed keys.

    It stands before a join by shuffle, so that rows without a partner, and what they carry, stay where they are. The
    join remains what decides. ``keys`` is read twice.
    """
    session = keys.sparkSession
    bits = min(SIEVE_BITS, 1 << max(16, (SIEVE_BITS_A_KEY * keys.count()).bit_length()))
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(bits))
    places = keys.select(place(keys[keys.columns[0]]).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = session.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda key: marked(place(key))


def columns_of(df: DataFrame, **wanted: Column) -> DataFrame:
    """Exactly the wanted columns, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*(c.alias(name) for name, c in wanted.items()))


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after this package was added to the session's Python files (once), so that every task can import it.

    A session without a limit of its own on the bytes of a batch gets ``BATCH_BYTES``.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root = os.path.dirname(package)
        path = os.path.join(tempfile.mkdtemp(prefix="labelmill-"), "labelmill.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, root))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df
