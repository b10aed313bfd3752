"""Grouping of spelling variants by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a reduced word, and two words that differ by one edit have
reduced words that are equal or differ by one edit. The full one-edit neighbourhood of a reduced word over so few
symbols is short enough to be generated and joined with the reduced vocabulary; what meets is verified on the words
themselves, as a condition of the join. Each pair of neighbouring reduced words is generated from one of its two ends
only: from the longer one by a deletion, or from the one with the lesser symbol by a replacement.

More symbols make longer neighbourhoods and fewer words that share a reduced word. The number of symbols follows the
vocabulary: it is the least for which a word shares its reduced word with few others.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import LOWER, UPPER
from labelmill.session import materialise

# Fixed values of the contract: what a run is, which runs lose a code point, and which words count.
LETTERS = r"[A-Za-zÀ-ÿ]"
DAMAGED = 31
LEAST_LENGTH, LEAST_N, MORE = 7, 2, 10

# Numbers of symbols to choose from, and the words that may share a reduced word with a word, on average over all words.
ALPHABETS = (4, 6, 8, 12, 16, 24, 32, 64)
SHARED = 2.0

# Words whose neighbourhoods are generated in one task.
TASK_WORDS = 40_000

_ALL = LOWER + "".join(map(chr, range(0xC0, 0x100)))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, damaged: int = DAMAGED) -> DataFrame:
    """Words of all texts and how often they occur: ``(word, n)``.

    A word is a maximal run of letters with A-Z lower-cased. A run for which ``damaged`` divides the crc32 of
    ``<doc_id>:<run>`` loses the code point at the remainder of that number by its length. Words of fewer than
    ``least_length`` code points or ``least_n`` occurrences are left out. A null text has no words, a null id is empty.
    """
    # A longer run can lose one code point and a shorter one can't gain any.
    found = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def reduced(word: Column, symbols: int) -> Column:
    """The word with every letter replaced by its symbol, a character from ``0`` on."""
    return F.translate(word, _ALL, "".join(chr(48 + zlib.crc32(c.encode()) % symbols) for c in _ALL))


def alphabet(vocabulary: DataFrame, choice: Sequence[int] = ALPHABETS, shared: float = SHARED) -> int:
    """The least number of symbols for which a word shares its reduced word with ``shared`` words (itself included) on average."""
    for symbols in choice[:-1]:
        sizes = vocabulary.groupBy(reduced(F.col("word"), symbols)).agg(F.count("*").cast("double").alias("m"))
        if (sizes.agg(F.sum(F.col("m") * F.col("m")) / F.sum("m")).first()[0] or 0.0) <= shared:
            return symbols
    return choice[-1]


def _neighbourhood(r: Column, symbols: int) -> Column:
    """The reduced word, its deletions, and its replacements by greater symbols."""
    places = F.sequence(F.lit(1), F.length(r))
    deleted = F.transform(places, lambda i: F.concat(F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r))))

    def raised(i: Column) -> Column:
        own = F.ascii(F.substring(r, i, F.lit(1)))
        greater = F.when(own < 47 + symbols, F.sequence(own + 1, F.lit(47 + symbols))).otherwise(F.array().cast("array<int>"))
        return F.transform(greater, lambda s: F.concat(F.substring(r, F.lit(1), i - 1), F.chr(s), F.substring(r, i + 1, F.length(r))))

    return F.concat(F.array(r), F.array_distinct(deleted), F.flatten(F.transform(places, raised)))


def near_words(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """Both directions of all pairs of words that differ by one inserted, deleted or replaced code point.

    ``vocabulary`` is ``(word, n)`` with distinct words; returns ``(word, n, other, other_n)``. Equal hashes of
    different reduced words only add candidates, which the words themselves decide.
    """
    symbols = symbols or alphabet(vocabulary)
    own = reduced(F.col("word"), symbols)
    # A word makes some fifty rows, so a file of words would be a long task.
    dealt = vocabulary.repartition(max(1, -(-vocabulary.count() // TASK_WORDS)), "word")
    asks = dealt.withColumn("r", own).select(
        F.explode(F.array_distinct(F.transform(_neighbourhood(F.col("r"), symbols), lambda x: F.xxhash64(x)))).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n")
    )
    holds = vocabulary.select(F.xxhash64(own).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Words of one reduced word meet in both directions, all others in one.
    same = reduced(F.col("a"), symbols) == reduced(F.col("b"), symbols)
    pairs = asks.join(holds, (asks["key"] == holds["key"]) & (F.levenshtein("a", "b", 1) == 1) & (~same | (F.col("a") < F.col("b"))))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    ))
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """The last word of each chain of forms: ``(word, root)`` for a table ``(word, form)`` without circles.

    A form is far more frequent than its word, so chains are as short as the logarithm of the largest count.
    """
    last = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = last.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(last.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        last = moved.drop("moved")


def group_variants(docs: DataFrame, symbols: int | None = None, more: int = MORE) -> DataFrame:
    """Words of all texts with the frequent form each is a variant of: ``(word, form, root, n, n_near, form_n)``.

    A word's form is its near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    ``more`` times its own; ``root`` follows forms to the last and is the word itself without one. ``docs`` needs
    ``doc_id`` and ``text``; other columns are ignored. Repeated rows count as often as they come; an empty table gives
    an empty one.
    """
    vocabulary = materialise(word_counts(docs), "vocabulary")
    near = near_words(vocabulary, symbols)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    words = vocabulary.join(best, "word", "left")
    has = -F.col("best.rank") >= more * F.col("n")
    words = words.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n"),
    )
    words = materialise(words, "words")
    ends = roots(words.filter("form IS NOT NULL"))
    out = words.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
