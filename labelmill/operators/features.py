"""TF-IDF and token-sequence features.

Vocabularies are counted by exploding each text once and combining map-side; the
texts themselves are not shuffled. Once a vocabulary is fitted (its size is an
argument, so it is bounded) documents are featurised row by row into sparse
vectors, which are never densified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.text import WORD_PATTERN, sequence_tokens, tokenize
from labelmill.session import local_copy

# Vocabulary sizes, sequence length and out-of-vocabulary id.
MAX_FEATURES = 5000
MAX_FEATURES_MULTICLASS = 10_000
NUM_WORDS = 10_000
SEQUENCE_LENGTH = 30
OOV_ID = 1

# A fitted vocabulary is held by the driver and shipped to every executor.
_VOCABULARY_LIMIT = 1_000_000


def _check_size(n: int) -> int:
    if not 0 < n <= _VOCABULARY_LIMIT:
        raise ValueError(f"vocabulary size must be in 1..{_VOCABULARY_LIMIT}")
    return n


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(term, cf, df)``: corpus and document frequency of every term.

    Each document contributes its tokens and, behind them, its distinct tokens; counting the two
    ranges apart gives both frequencies from one explode, without grouping by document. The outer
    explode avoids the filter that Spark would otherwise add, which tokenises every text again.
    """
    cells = _token_cells(df, tokenize(F.col(text)))
    repeat, distinct = F.col("p") < F.col("m"), F.col("p") >= F.col("m")
    return cells.groupBy("term").agg(F.count_if(repeat).alias("cf"), F.count_if(distinct).alias("df"))


def _token_cells(df: DataFrame, tokens: Column, *also: str) -> DataFrame:
    """``(…, m, p, term)``: the ``m`` tokens of a row at ``p < m``, its distinct tokens in order of appearance after."""
    arrays = df.select(*also, tokens.alias("t"))
    both = F.concat("t", F.array_distinct("t"))
    cells = arrays.select(*also, F.size("t").alias("m"), F.posexplode_outer(both).alias("p", "term"))
    return cells.filter(F.col("term").isNotNull())


def tfidf_fit(df: DataFrame, max_features: int = MAX_FEATURES, text: str = "text") -> DataFrame:
    """Vocabulary ``(term, idx, df, cf, idf)``: the most frequent terms, indexed alphabetically.

    Ties at the cut go to the alphabetically first term; ``idf = ln((1 + n) / (1 + df)) + 1``.
    """
    _check_size(max_features)
    top = term_counts(df, text).orderBy(F.desc("cf"), "term").limit(max_features)
    rows = df.agg(F.count("*")).scalar()
    # The window sees at most ``max_features`` rows.
    vocab = top.select(
        "term",
        (F.row_number().over(W.orderBy("term")) - 1).cast("int").alias("idx"),
        "df",
        "cf",
        (F.ln((1 + rows) / (1 + F.col("df"))) + 1).alias("idf"),
    )
    return local_copy(vocab)


def tfidf_model(vocab: DataFrame, text: str = "text", out: str = "features") -> PipelineModel:
    """Row-wise transformer from text to sparse, L2-normalised TF-IDF vectors.

    Terms outside the vocabulary are ignored; a text without known terms becomes the zero vector.
    """
    rows = sorted(vocab.select("idx", "term", "idf").collect())
    _check_size(len(rows))
    return PipelineModel(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", gaps=False, pattern=WORD_PATTERN, minTokenLength=2),
            CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="_tokens", outputCol="_tf"),
            ElementwiseProduct(
                scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf", outputCol="_weighted"
            ),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=out),
        ]
    )


def tfidf_transform(df: DataFrame, vocab: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the TF-IDF vector; no shuffle."""
    return tfidf_model(vocab, text, out).transform(df).drop("_tokens", "_tf", "_weighted")


def vector_cells(df: DataFrame, features: str = "features", row_id: str = "row_id") -> DataFrame:
    """Long form ``(row_id, idx, w)`` of a sparse vector column; no shuffle."""
    parts = F.unwrap_udt(F.col(features))
    cells = df.select(row_id, F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("w")).alias("cells"))
    return cells.select(row_id, F.inline_outer("cells")).filter(F.col("idx").isNotNull())


def feature_stats(df: DataFrame, vocab: DataFrame, features: str = "features", row_id: str = "row_id") -> DataFrame:
    """Mean and population standard deviation (plus 1e-8) of every feature, zeros included."""
    sums = vector_cells(df, features, row_id).groupBy("idx").agg(
        F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("s2")
    )
    n = df.agg(F.count("*")).scalar()
    mean = F.coalesce("s1", F.lit(0.0)) / n
    spread = F.greatest(F.coalesce("s2", F.lit(0.0)) / n - mean * mean, F.lit(0.0))
    return vocab.join(sums, "idx", "left").select(
        "idx", "term", mean.alias("mean"), (F.sqrt(spread) + F.lit(1e-8)).alias("scale")
    )


def sequence_fit(
    df: DataFrame, num_words: int = NUM_WORDS, text: str = "text", row_id: str = "row_id"
) -> DataFrame:
    """``(term, id, n)`` of the words that get an id of their own: 2..num_words-1.

    Ids follow falling frequency, then first appearance (row, then position). Id 1 stands for
    every other word, so the list ends where ids would reach ``num_words``.
    """
    _check_size(num_words)
    cells = _token_cells(df, sequence_tokens(F.col(text)), row_id)
    # One row per document and distinct term carries a position, so the smallest row id has no ties.
    distinct = F.col("p") >= F.col("m")
    row, pos = F.when(distinct, F.col(row_id)), F.when(distinct, F.col("p") - F.col("m"))
    counts = cells.groupBy("term").agg(
        F.count_if(~distinct).alias("n"), F.min(row).alias("first_row"), F.min_by(pos, row).alias("first_pos")
    )
    order = [F.desc("n"), F.asc("first_row"), F.asc("first_pos")]
    top = counts.orderBy(*order).limit(max(num_words - 2, 0))
    # The window sees at most ``num_words`` rows.
    words = top.select("term", (F.row_number().over(W.orderBy(*order)) + 1).cast("int").alias("id"), "n")
    return local_copy(words)


def _lookup(df: DataFrame, tokens: Column, vocab: DataFrame, row_id: str, out: str) -> DataFrame:
    """Token array to id array, batch by batch in Arrow.

    A join would have to explode every text and shuffle it back together. The vocabulary is small
    (its size is an argument of the fit), so each task looks whole columns up in it, and no row moves.
    """
    words = vocab.select("term", "id").collect()
    _check_size(max(len(words), 1))
    terms, ids = [w["term"] for w in words], [w["id"] for w in words]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = pa.array(ids, pa.int32())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=pa.array(terms, pa.string()).cast(flat.type))
            found = pc.fill_null(pc.take(id_of, at), OOV_ID)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, found)], names=[row_id, out])

    id_type = dict(df.dtypes)[row_id]
    return df.select(row_id, tokens.alias(out)).mapInArrow(convert, f"`{row_id}` {id_type}, `{out}` array<int>")


def to_sequences(
    df: DataFrame, vocab: DataFrame, text: str = "text", row_id: str = "row_id", out: str = "sequence"
) -> DataFrame:
    """Whole texts as id arrays; unknown words become 1."""
    return _lookup(df, sequence_tokens(F.col(text)), vocab, row_id, out)


def pad(c: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Fixed length: zeros after short sequences, the last ids of long ones."""
    tail = F.when(F.size(c) > length, F.slice(c, -length, length)).otherwise(c)
    return F.concat(tail, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(c), F.lit(0))))


def padded_sequences(
    df: DataFrame,
    vocab: DataFrame,
    length: int = SEQUENCE_LENGTH,
    text: str = "text",
    row_id: str = "row_id",
    out: str = "sequence",
) -> DataFrame:
    """Padded id sequences. Padding keeps the last ``length`` tokens only, so only those are looked up."""
    tokens = sequence_tokens(F.col(text))
    tail = F.when(F.size(tokens) > length, F.slice(tokens, -length, length)).otherwise(tokens)
    found = _lookup(df, tail, vocab, row_id, out)
    return found.select(row_id, pad(F.col(out), length).alias(out))
