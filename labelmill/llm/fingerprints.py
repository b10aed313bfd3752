"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once; the leading bits of the hash choose a bin, and each
bin keeps its least hash. An empty bin borrows from the first filled bin in a random
order of bins that belongs to the empty bin alone (the optimal densification of
one-permutation hashing: the order is the same for every document, so two documents
borrow alike as often as they are alike). Of each bin only the low-order byte is
stored, and the share of equal bytes is corrected for those that agree by chance.

All work is array expressions on one row; nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.llm.common import SPACES

BIN_BITS = 7
BINS = 1 << BIN_BITS
SHINGLE_WORDS = 5
KEPT_BITS = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``words`` words of the lower-cased text.

    A text with fewer words gives one hash of its whole sequence, a text without words none.
    """

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
        return F.when(F.size(w) >= words, runs).otherwise(F.array(F.xxhash64(w)))

    trimmed = F.btrim(F.lower(text), F.lit(SPACES))
    none = F.array().cast("array<bigint>")
    return F.when(F.length(trimmed) > 0, let(F.split(trimmed, "[ \\t-\\r]+"), hashes)).otherwise(none)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + (BINS >> 1)


def fingerprint(text: Column) -> Column:
    """``array<tinyint>`` of one byte per bin; empty for a text without words (a null text is one)."""

    def least(s: Column) -> Column:
        # Sorted hashes are sorted by bin; the first of each bin is its least.
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, F.greatest(i - 1, F.lit(0))))))

    def with_gaps(m: Column) -> Column:
        gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n.cast("int"))
        before = lambda i: F.when(i > 0, _bin(F.get(m, F.greatest(i - 1, F.lit(0))))).otherwise(F.lit(-1))
        runs = F.transform(m, lambda x, i: F.concat(gap(_bin(x) - before(i) - 1), F.array(x)))
        return F.concat(F.flatten(runs), gap(BINS - 1 - _bin(F.element_at(m, -1))))

    def densified(m: Column) -> Column:
        def borrowed(b: Column) -> Column:
            order = F.transform(m, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("at"), x.alias("x")))
            return F.array_min(order)["x"]

        full = F.transform(with_gaps(m), lambda x, b: F.coalesce(x, borrowed(b)))
        return F.when(F.size(m) == BINS, m).otherwise(full)

    def kept(m: Column) -> Column:
        low = F.transform(densified(m), lambda x: (x.bitwiseAND((1 << KEPT_BITS) - 1) - (1 << KEPT_BITS - 1)).cast("tinyint"))
        return F.when(F.size(m) > 0, low).otherwise(F.array().cast("array<tinyint>"))

    return let(F.sort_array(shingle_hashes(F.coalesce(text, F.lit("")))), lambda s: let(least(s), kept))


def packed(fp: Column) -> Column:
    """A fingerprint as text: two hexadecimal digits per bin."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("bigint") + (1 << KEPT_BITS - 1)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, corrected for bytes that agree by chance; two texts without words are alike (1)."""
    chance = 1 / (1 << KEPT_BITS)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    corrected = F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(corrected)
    )


def with_next(df: DataFrame, order: list[str], carried: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by ``order`` (after the last: the first).

    The first order column must be numeric. Rows are dealt to as many ranges of it as the session has shuffle
    partitions and ordered within their range; each range's last row takes the first row of the next range.
    ``derived`` columns are computed from a row's own columns and carried as well.
    """
    spark, first = df.sparkSession, order[0]
    derived = derived or {}
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.select(first).approxQuantile(first, asked, 0.25 / parts))) if asked else []
    # Two levels of bounds, so that a row is compared with about twice the root of their number.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    value = F.coalesce(F.col(first).cast("double"), F.lit(float("-inf")))
    below = lambda array: F.size(F.filter(array, lambda b: b <= value))
    doubles = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    if groups:
        coarse = below(doubles([g[0] for g in groups]))
        fine = below(F.get(F.array(*map(doubles, groups)), F.greatest(coarse - 1, F.lit(0))))
        range_ = F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0)
    else:
        range_ = F.lit(0)
    ranged = df.withColumn("range__", range_)
    by = [F.col(c).asc_nulls_first() for c in order]
    # The first row of each range, found on the order columns alone; there are as many as ranges.
    heads = ranged.groupBy("range__").agg(F.min(F.struct(*order)).alias("head")).orderBy("range__").collect()
    following = [(h["range__"], *heads[(i + 1) % len(heads)]["head"]) for i, h in enumerate(heads)]
    key = [f"key{i}__" for i in range(len(order))]
    kinds = dict(df.dtypes)
    after = spark.createDataFrame(following, ", ".join(["of__ int", *(f"{k} {kinds[c]}" for k, c in zip(key, order, strict=True))]))
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(key, order, strict=True)]
    fields = [*carried, *derived]
    head = (
        df.join(F.broadcast(after), same).select("of__", *carried, *(c.alias(n) for n, c in derived.items()))
        .groupBy("of__").agg(F.first(F.struct(*fields)).alias("head__"))
    )
    own = ranged.select("*", *(c.alias(n) for n, c in derived.items()))
    lead = F.lead(F.struct(*fields)).over(W.partitionBy("range__").orderBy(*by))
    joined = own.withColumn("lead__", lead).join(head, F.col("range__") == F.col("of__"), "left")
    chosen = F.coalesce("lead__", "head__")
    return joined.select(*df.columns, *derived, *(chosen[f].alias(f"next_{f}") for f in fields))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text, and compare.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the
    next document by ascending ``doc_id`` (null ids first, equal ids by a hash of the text; after the last: the first,
    which is the document itself if it is alone). ``docs`` needs ``doc_id`` and ``text`` (null: empty); other columns
    are ignored. One row per row: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("tie", F.xxhash64("text"))
    pairs = with_next(rows, ["doc_id", "tie"], ["text"], {"fp": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = pairs.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited")))
    return done.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
