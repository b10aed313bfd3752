"""Language ID: a linear-chain conditional random field over the words of code-switched text.

A word's features are its byte n-grams (up to four bytes, with marks at both ends, so those that touch a mark are
affixes) and its entry in a lexicon: for words that make up a given share of some language's words, the language in
which they are relatively most frequent and how clearly. The lexicon is counted over all training documents. Weights
and label transitions are fitted by maximum likelihood on a bounded sample; half of its sequences are spliced from two
documents, so that transitions between languages are learnt as well. Words are labelled by forward-backward, in
sequences of at most 64 words that cover the whole text, and a text's language is the one with the largest expected
share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import fold_crc, shipped, slices, texts, tidied
from labelmill.llm.words import BASE, CHUNK_BYTES, NOT_LETTERS, mixed, words_of
from labelmill.session import materialise

UNDETERMINED = "und"

# Words of one sequence.
STEPS = 64
BUCKETS = 1 << 16
LONGEST_GRAM = 4
GRAM_SALT = BASE * np.arange(LONGEST_GRAM + 1, dtype=np.uint64)

# Share of a language's words from which a word is in the lexicon: at most 10,000 words for each language.
LEXICON_SHARE = 1e-4
CLARITY = np.array([0.3, 0.5, 0.7, 0.9, 0.99])

# The fit sample: this many documents of each language, about, of at most so many bytes (a bound on labelled rows used
# for fitting only; the lexicon and all predictions use all documents).
FIT_DOCS = 150
FIT_BYTES = 65_536
# Share of a language's longest n-grams from which one is known, and how often it must occur at least: at most 500,000
# for each language and half of the documents. A word is placed in a language that knows so much of its n-grams.
KNOWN_SHARE = 2e-6
KNOWN_TIMES = 2
PLACED = 0.75

# Bytes of text whose words are counted or placed together.
COUNT_BYTES = 1 << 20

# Sequences whose paths are summed up together.
MARGINAL_SEQUENCES = 512

ROUNDS = 40
PENALTY = 1e-6
MOST_LANGUAGES = 1000


@dataclass
class LanguageModel:
    """Weights of a fitted field; ``languages`` are in order of their names."""

    languages: list[str]
    grams: np.ndarray  # (BUCKETS + 1, languages); the last row is empty
    lexicon: np.ndarray  # hashes of its words, sorted
    entry: np.ndarray  # feature of each
    entries: np.ndarray  # (features, languages); the last row is of words that aren't in it
    start: np.ndarray
    transition: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each distinct word for each language."""
        score = self.entries[self.entry_of(words.distinct)]
        for gram in words.grams:
            score = score + np.add.reduceat(self.grams[gram], words.begins)
        return score

    def entry_of(self, word: np.ndarray) -> np.ndarray:
        missing = len(self.entries) - 1
        if not len(self.lexicon):
            return np.full(len(word), missing)
        place = np.minimum(np.searchsorted(self.lexicon, word), len(self.lexicon) - 1)
        return np.where(self.lexicon[place] == word, self.entry[place], missing)


class Words:
    """The words of some texts: each token's distinct word, and the n-grams of the distinct words."""

    def __init__(self, batch: list[bytes]):
        joined, hashes, starts, lengths, self.bounds = words_of(batch, NOT_LETTERS)
        self.joined, self.starts, self.lengths = joined, starts, lengths
        self.distinct, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        size = lengths[first] + 2
        self.sizes, self.begins = size, np.cumsum(size) - size
        n = int(size.sum())
        place = np.arange(n) - np.repeat(self.begins, size)
        raw = np.frombuffer(joined, np.uint8)
        inner = (place > 0) & (place < np.repeat(size - 1, size))
        byte = np.where(place == 0, 1, 2).astype(np.uint64)  # marks of the two ends
        byte[inner] = raw[(np.repeat(starts[first], size) + place - 1)[inner]]
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        left = np.repeat(size, size) - place
        self.grams = []
        key = np.zeros(n, np.uint64)
        for length in range(1, LONGEST_GRAM + 1):
            key = key * np.uint64(256)
            key[: n - length + 1] += byte[length - 1 :]
            bucket = (mixed(key + GRAM_SALT[length]) & np.uint64(BUCKETS - 1)).astype(np.int64)
            fits = (left >= length) & (inner if length == 1 else True)
            self.grams.append(np.where(fits, bucket, BUCKETS))
        # The longest n-grams as they are; no letter is 0, so 0 is none.
        self.longest = np.where(fits, key, 0).astype(np.uint32)

    def layout(self) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and step of each token: every text begins a new sequence."""
        counts = np.diff(self.bounds)
        sequences = -(-counts // STEPS)
        base = np.cumsum(sequences) - sequences
        inside = np.arange(len(self.at)) - np.repeat(self.bounds[:-1], counts)
        return np.repeat(base, counts) + inside // STEPS, inside % STEPS


def forward_backward(score: np.ndarray, filled: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word, expected transitions, and the log of all paths' weight.

    ``score`` is (sequences, steps, labels), ``filled`` (sequences, steps) with the words of a sequence first.
    """
    sequences, steps, labels = score.shape
    top = score.max(axis=2, keepdims=True)
    psi = np.exp(score - top)
    move, peak = np.exp(transition - transition.max()), transition.max()
    forward, backward, scale = np.empty_like(psi), np.ones_like(psi), np.ones((sequences, steps))
    now = np.exp(start) * psi[:, 0]
    for t in range(steps):
        if t:
            now = np.where(filled[:, t, None], (forward[:, t - 1] @ move) * psi[:, t], forward[:, t - 1])
        total = now.sum(axis=1, keepdims=True)
        forward[:, t] = now / total
        scale[:, t] = total[:, 0]
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        ahead = psi[:, t + 1] * backward[:, t + 1]
        back = ahead @ move.T
        more = filled[:, t + 1, None]
        backward[:, t] = np.where(more, back / scale[:, t + 1, None], 1.0)
        expected += (forward[:, t] * more / scale[:, t + 1, None]).T @ np.where(more, ahead, 0.0) * move
    marginal = forward * backward
    marginal /= marginal.sum(axis=2, keepdims=True)
    log_total = float((np.log(scale) * filled).sum() + (top[:, :, 0] * filled).sum() + peak * filled[:, 1:].sum())
    return marginal, expected, log_total


def _spliced(sequence: np.ndarray, step: np.ndarray, word: np.ndarray, label: np.ndarray, rng: np.random.Generator):
    """Sequences as matrices of words and labels (-1: none); every second one goes on as another from some word on."""
    n = int(sequence.max()) + 1
    words, labels = np.full((n, STEPS), -1), np.full((n, STEPS), -1)
    words[sequence, step], labels[sequence, step] = word, label
    order = rng.permutation(n)
    words, labels = words[order], labels[order]
    cut = rng.integers(1, STEPS, n)
    for i in range(0, n - 1, 2):
        tail = labels[i + 1] >= 0
        begin = min(cut[i], int((labels[i] >= 0).sum()))
        kept = np.flatnonzero(tail)[: STEPS - begin]
        words[i, begin:], labels[i, begin:] = -1, -1
        words[i, begin : begin + len(kept)], labels[i, begin : begin + len(kept)] = words[i + 1, kept], labels[i + 1, kept]
    return words, labels


def fit(sample: list[tuple[bytes, int]], languages: list[str], lexicon: np.ndarray, entry: np.ndarray, entries: int, rounds: int = ROUNDS) -> LanguageModel:
    """Maximum-likelihood weights on a sample of ``(text, language number)``, by adaptive gradient steps."""
    labels = len(languages)
    model = LanguageModel(
        languages, np.zeros((BUCKETS + 1, labels)), lexicon, entry, np.zeros((entries + 1, labels)), np.zeros(labels), np.zeros((labels, labels))
    )
    words = Words([t for t, _ in sample])
    if not len(words.at):
        return model
    sequence, step = words.layout()
    of = np.repeat([label for _, label in sample], np.diff(words.bounds))
    at, gold = _spliced(sequence, step, words.at, of, np.random.default_rng(0))
    filled = at >= 0
    at = np.where(filled, at, 0)
    position = np.repeat(np.arange(len(words.begins)), np.diff(np.append(words.begins, len(words.grams[0]))))
    lex = model.entry_of(words.distinct)
    one_hot = np.eye(labels)
    gold_hot = np.where(filled[:, :, None], one_hot[np.maximum(gold, 0)], 0.0)
    both = filled[:, 1:] & filled[:, :-1]
    gold_moves = np.zeros((labels, labels))
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    gold_start = one_hot[gold[filled[:, 0], 0]].sum(axis=0)
    tokens = filled.sum()
    parameters = [model.grams, model.entries, model.start, model.transition]
    squares = [np.full_like(p, 1e-8) for p in parameters]
    for _ in range(rounds):
        emission = model.emissions(words)
        marginal, moves, _ = forward_backward(emission[at], filled, model.start, model.transition)
        error = np.where(filled[:, :, None], gold_hot - marginal, 0.0)
        by_word = np.stack([np.bincount(at.ravel(), error[:, :, k].ravel(), minlength=len(words.distinct)) for k in range(labels)], axis=1)
        grams = np.zeros_like(model.grams)
        for gram in words.grams:
            for k in range(labels):
                grams[:, k] += np.bincount(gram, by_word[position, k], minlength=BUCKETS + 1)
        grams[BUCKETS] = 0.0
        entries_ = np.stack([np.bincount(lex, by_word[:, k], minlength=len(model.entries)) for k in range(labels)], axis=1)
        gradients = [grams, entries_, gold_start - marginal[filled[:, 0], 0].sum(axis=0), gold_moves - moves]
        for p, g, s in zip(parameters, gradients, squares, strict=True):
            g = g / tokens - PENALTY * p
            s += g * g
            p += 0.2 * g / np.sqrt(s)
    model.grams = model.grams.astype(np.float32)
    return model


def lexicon_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``(word, language, n)`` over all words of documents with ``text`` and ``language`` (a number)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=COUNT_BYTES):
            _, hashes, _, _, bounds = words_of([t or b"" for t in texts(batch)], NOT_LETTERS)
            language = np.repeat(batch.column("language").to_numpy(), np.diff(bounds))
            for k in np.unique(language):
                word, n = np.unique(hashes[language == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(np.full(len(word), k, np.int32)), pa.array(n.astype(np.int64))], ["word", "language", "n"]
                )

    partial = shipped(docs.select("text", "language")).mapInArrow(tidied(count), "word bigint, language int, n bigint")
    return partial.groupBy("word", "language").agg(F.sum("n").alias("n"))


def _lexicon(docs: DataFrame, languages: list[str], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and their features: language times clarity. Bounded by ``1 / share`` words for each language."""
    counts = materialise(lexicon_counts(docs, languages), "lexicon")
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}  # one row per language
    if not totals:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = F.create_map(*(F.lit(x) for pair in totals.items() for x in pair))[F.col("language")]
    rates = counts.withColumn("rate", F.col("n") / total)
    frequent = rates.filter(F.col("rate") >= share).select("word").distinct()
    table = rates.join(frequent, "word").select("word", "language", "rate").toArrow()
    word, at = np.unique(table["word"].to_numpy().view(np.uint64), return_inverse=True)
    rate = np.zeros((len(word), len(languages)))
    rate[at, table["language"].to_numpy()] = table["rate"].to_numpy()
    best = rate.argmax(axis=1)
    clear = np.searchsorted(CLARITY, rate.max(axis=1) / rate.sum(axis=1), side="right")
    return word, best * (len(CLARITY) + 1) + clear


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, share: float = LEXICON_SHARE) -> LanguageModel | None:
    """Learn from all documents with a ``lang`` (``doc_id, text, lang``); None if there are none."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
    numbered = known.withColumn("language", number[F.col("lang")])
    lexicon, entry = _lexicon(numbered, languages, share)
    rate = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, fit_docs / r["count"]))))
    unit = F.xxhash64("doc_id", F.lit("fit")).cast("double") / 2.0**64 + 0.5
    rows = numbered.filter((unit < rate[F.col("lang")]) & (F.octet_length("text") <= FIT_BYTES)).select("doc_id", "text", "language").collect()
    sample = [(r["text"].encode(), r["language"]) for r in sorted(rows, key=lambda r: (r["language"], str(r["doc_id"]), r["text"]))]
    return fit(sample, languages, lexicon, entry, len(languages) * (len(CLARITY) + 1))


def _marginals(model: LanguageModel, words: Words) -> np.ndarray:
    """Label probabilities of each token; sequences are independent of each other and taken some at a time."""
    sequence, step = words.layout()
    emission = model.emissions(words)
    found = np.empty((len(sequence), len(model.languages)))
    for first in range(0, int(sequence.max()) + 1, MARGINAL_SEQUENCES):
        begin, end = np.searchsorted(sequence, (first, first + MARGINAL_SEQUENCES))
        at = sequence[begin:end] - first, step[begin:end]
        n = int(at[0][-1]) + 1
        score = np.zeros((n, STEPS, len(model.languages)), emission.dtype)
        score[at] = emission[words.at[begin:end]]
        filled = np.zeros((n, STEPS), bool)
        filled[at] = True
        found[begin:end] = forward_backward(score, filled, model.start, model.transition)[0][at]
    return found


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every whole text, one row per row.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learnt. ``score`` is
    the expected share of words in the predicted language. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, size=CHUNK_BYTES):
            raw = [t or b"" for t in texts(batch)]
            words = Words(raw)
            counts = np.diff(words.bounds)
            names, scores = [UNDETERMINED] * len(raw), np.zeros(len(raw))
            if m is not None and len(words.at):
                of = np.repeat(np.arange(len(raw)), counts)
                marginal = _marginals(m, words)
                sums = np.stack([np.bincount(of, marginal[:, k], minlength=len(raw)) for k in range(len(m.languages))], axis=1)
                best = sums.argmax(axis=1)
                for i in np.flatnonzero(counts):
                    # Bytes of other characters than ASCII need not be letters.
                    if raw[i].isascii() or any(c.isalpha() for c in raw[i].decode()):
                        names[i], scores[i] = m.languages[best[i]], min(1.0, sums[i, best[i]] / counts[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return shipped(docs.select("doc_id", "text")).mapInArrow(tidied(guess), schema)


def label_words(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, words)``: each text's words in order with their most probable language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, size=CHUNK_BYTES // 4):
            words = Words([t or b"" for t in texts(batch)])
            marginal = _marginals(m, words) if len(words.at) else np.zeros((0, len(m.languages)))
            found = [
                {"word": words.joined[s : s + n].decode(errors="replace"), "lang": m.languages[k], "probability": float(p)}
                for s, n, k, p in zip(words.starts, words.lengths, marginal.argmax(axis=1), marginal.max(axis=1), strict=True)
            ]
            lists = [found[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(item))], ["doc_id", "words"])

    kind = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType())]))
    return shipped(docs.select("doc_id", "text")).mapInArrow(label, T.StructType([docs.schema["doc_id"], T.StructField("words", kind)]))


def _fold(docs: DataFrame) -> Column:
    """One of two halves of the documents, by id; rows with one id are in one half."""
    return (fold_crc("doc_id", 2) == 1).cast("int")


def _fold_key(fold: np.ndarray, language: np.ndarray) -> np.ndarray:
    return fold.astype(np.uint64) << np.uint64(48) | language.astype(np.uint64) << np.uint64(32)


def known_grams(docs: DataFrame, languages: list[str], share: float = KNOWN_SHARE, least: int = KNOWN_TIMES) -> np.ndarray:
    """The longest n-grams of each language in each half of its documents: sorted keys of half, language and bytes.

    One is known if it makes up ``share`` of the half's n-grams of the language and occurs ``least`` times.
    """
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("text", number[F.col("lang")].alias("language"), _fold(docs).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=COUNT_BYTES):
            words = Words([t or b"" for t in texts(batch)])
            group = np.repeat(_fold_key(batch.column("fold").to_numpy(), batch.column("language").to_numpy()), np.diff(words.bounds))
            gram, at = np.unique(words.longest, return_inverse=True)
            for k in np.unique(group):
                times = np.bincount(words.at[group == k], minlength=len(words.begins))
                n = np.bincount(at, np.repeat(times, words.sizes)).astype(np.int64)
                some = np.flatnonzero((n > 0) & (gram > 0))
                yield pa.RecordBatch.from_arrays([pa.array((k | gram[some].astype(np.uint64)).view(np.int64)), pa.array(n[some])], ["key", "n"])

    partial = shipped(known).mapInArrow(tidied(count), "key bigint, n bigint")
    counts = materialise(partial.groupBy("key").agg(F.sum("n").alias("n")).withColumn("group", F.shiftright("key", 32)), "grams")
    totals = counts.groupBy("group").agg(F.greatest(F.sum("n") * share, F.lit(least)).alias("least"))
    return np.sort(counts.join(totals, "group").filter("n >= least").select("key").toArrow()["key"].to_numpy().view(np.uint64))


def _placed(model: LanguageModel, known: np.ndarray, words: Words, fold: np.ndarray) -> np.ndarray:
    """Whether each token is made of n-grams that the other half of the documents knows in the field's label of it.

    ``fold`` is each token's half. Words of one letter have no such n-gram and are in no language.
    """
    labels = len(model.languages)
    pair, at = np.unique((words.at * labels + _marginals(model, words).argmax(axis=1)) * 2 + fold, return_inverse=True)
    word, language, half = pair // (2 * labels), pair // 2 % labels, pair % 2
    size = words.sizes[word]
    begins = np.cumsum(size) - size
    gram = words.longest[np.arange(size.sum()) + np.repeat(words.begins[word] - begins, size)]
    key = np.repeat(_fold_key(1 - half, language), size) | gram
    place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
    found = (known[place] == key) & (gram > 0) if len(known) else np.zeros(len(key), bool)
    covered = np.add.reduceat(found.astype(np.int64), begins)
    return (covered >= PLACED * np.maximum(size - LONGEST_GRAM + 1, 1))[at]


def placed_share(docs: DataFrame, model: LanguageModel, known: np.ndarray) -> DataFrame:
    """``(row, placed)``: the share of each whole text's letters in words placed in a learnt language, 0 without words.

    ``row`` is :func:`_row` of the document. A document is judged by n-grams of the other half of the documents, never
    by its own. Letters are counted as bytes, so that scraps of codes and short words that languages share by chance
    weigh little. Unlike the score of ``predict``, it has no least value that follows from the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value
        for batch in slices(batches, size=COUNT_BYTES):
            raw = [t or b"" for t in texts(batch)]
            words = Words(raw)
            share = np.zeros(len(raw))
            if len(words.at):
                of = np.repeat(np.arange(len(raw)), np.diff(words.bounds))
                letters = np.bincount(of, words.lengths, minlength=len(raw))
                placed = _placed(m, grams, words, batch.column("fold").to_numpy()[of])
                share = np.bincount(of, words.lengths * placed, minlength=len(raw)) / np.maximum(letters, 1)
            for i in np.flatnonzero(share):
                # Bytes of other characters than ASCII need not be letters.
                if not raw[i].isascii() and not any(c.isalpha() for c in raw[i].decode()):
                    share[i] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(share)], ["row", "placed"])

    rows = docs.select(_row().alias("row"), _fold(docs).alias("fold"), "text")
    return shipped(rows).mapInArrow(tidied(judge), "row string, placed double")


def _row() -> Column:
    """What tells documents apart: id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def identify_held_out(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from all folds but one (crc32 of the id as text) and predict every document, with ``held_out``."""
    out: Column = fold_crc("doc_id", folds) == held
    model = train(docs.filter(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.25) -> DataFrame:
    """The documents with ``least_score`` of their letters in words placed in learnt languages; columns as they are.

    Words count in whichever learnt language they are, so text that switches between these stays, and text in none of
    them goes, with or without a ``lang`` of its own: the documents of one half vouch for those of the other. Rows are
    judged one by one, also those that share an id; null, empty and letterless texts go. If no document has a ``lang``,
    all with a letter stay. More than ``MOST_LANGUAGES`` values of ``lang`` are an error.
    """
    model = train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shares = placed_share(docs, model, known_grams(docs, model.languages))
    gone = materialise(shares.filter(F.col("placed") < least_score).select("row").distinct(), "rejected")
    judged = docs.withColumn("row__", _row())
    return judged.join(gone, judged["row__"] == gone["row"], "left_anti").select(*docs.columns)
