"""LM scoring with a Brown class-based bigram model.

    P(word | word before) = P(class | class before) * P(word | class)

Every training word has a class of its own choice. Exchange clustering moves each word in turn to the class that raises
the likelihood of the class bigrams most: on the driver for the most frequent words and, as a beginning for all others,
the suffixes of three bytes; then in rounds over the texts for all words that tasks hold in memory; last, in order of
frequency as in Brown's paper, each rarer word by all its neighbours. Words not seen in training belong to the class of
their suffix. Class transitions are smoothed by interpolation with the classes' frequencies, words by one added count,
with one more word per suffix for all unseen ones; so the model is a distribution over the training words and "unseen".

All counts are of all training documents. Only bounded statistics reach the driver: type bigrams (at most the square of
``1 / own_share + SUFFIX_TYPES``), class bigrams, and the words above ``table_share`` of all tokens (at most its
inverse) with their classes, which tasks look up in memory. Rarer words are joined by shuffle; none of them is frequent,
so no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import fold_crc, shipped, slices, texts
from labelmill.llm.words import BASE, CHUNK_BYTES, mixed, words_of
from labelmill.session import materialise

# Share of all tokens from which the driver moves a word (so there are at most 1000), and from which tasks hold its
# count and class in memory (at most 5 million).
OWN_SHARE = 1e-3
TABLE_SHARE = 2e-7

SUFFIX_TYPES = 512
CLASSES = 64
SWEEPS = 10

# Rounds of exchange over the words in memory after those of the driver, each of which moves one half of them.
ROUNDS = 4

# Words whose gains are computed together.
CHUNK_CHOICES = 4096

# Distinct words that a task counts before it passes them on.
FLUSH_WORDS = 2_000_000

# The end of a text is a token like a word; no word hashes to it but by chance.
END = np.uint64(0x454E442D4F462D54)


def _suffixes(joined: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix type (from 0) of each word."""
    raw = np.frombuffer(joined, np.uint8)
    key = np.zeros(len(starts), np.uint64)
    for back in range(1, 4):
        long_enough = lengths >= back
        at = np.where(long_enough, starts + lengths - back, 0)
        byte = np.where(long_enough, raw[at] if len(raw) else 0, 0).astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        key = key * np.uint64(256) + byte
    return (mixed(key + BASE) % np.uint64(SUFFIX_TYPES)).astype(np.int64)


def _tokens(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix of every token (words, then one end per text), its text, and where the ends are."""
    joined, hashes, starts, lengths, bounds = words_of(batch)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(batch)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    word = np.ones(len(text), bool)
    word[ends] = False
    token, suffix = np.full(len(text), END, np.uint64), np.full(len(text), -1, np.int64)
    token[word], suffix[word] = hashes, _suffixes(joined, starts, lengths)
    return token, suffix, text, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, suffix, n)`` of every distinct token of the texts; words as hashes, the end with suffix -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, suffix, n = (np.concatenate(c) for c in zip(*held, strict=True))
            distinct, first, at = np.unique(word, return_index=True, return_inverse=True)
            return distinct, suffix[first], np.bincount(at, n).astype(np.int64)

        def batch_of(word: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(suffix.astype(np.int32)), pa.array(n)], ["word", "suffix", "n"])

        waiting = 0
        for batch in slices(batches, size=CHUNK_BYTES):
            token, suffix, _, _ = _tokens([t or b"" for t in texts(batch)])
            distinct, first, n = np.unique(token, return_index=True, return_counts=True)
            held.append((distinct, suffix[first], n))
            waiting += len(distinct)
            if waiting > FLUSH_WORDS:
                held = [merged()]
                waiting = len(held[0][0])
                if waiting > FLUSH_WORDS // 2:
                    yield batch_of(*held[0])
                    held, waiting = [], 0
        if held:
            yield batch_of(*merged())

    partial = shipped(docs.select("text")).mapInArrow(count, "word bigint, suffix int, n bigint")
    return partial.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    return x * np.log(np.where(x > 0, x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type, by exchange clustering of a matrix of type bigram counts."""
    types = len(bigrams)
    total = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(types, np.int64)
    of[order] = np.arange(types) % classes
    member = np.zeros((types, classes))
    member[np.arange(types), of] = 1.0
    counts = bigrams.astype(float)
    after, before = counts @ member, counts.T @ member  # of each type: its followers and forerunners by class
    pairs = member.T @ after
    out, in_ = counts.sum(axis=1), counts.sum(axis=0)
    class_out, class_in = member.T @ out, member.T @ in_

    everywhere = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            old, self_ = of[w], counts[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= self_
            left[old] -= self_
            pairs[old] -= right
            pairs[:, old] -= left
            pairs[old, old] -= self_
            class_out[old] -= out[w]
            class_in[old] -= in_[w]
            rows = (_f(pairs + right) - _f(pairs)).sum(axis=1)
            columns = (_f(pairs + left[:, None]) - _f(pairs)).sum(axis=0)
            own = pairs[everywhere, everywhere]
            both = _f(own + right + left + self_) - _f(own + right) - _f(own + left) + _f(own)
            gain = rows + columns + both - (_f(class_out + out[w]) - _f(class_out)) - (_f(class_in + in_[w]) - _f(class_in))
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            pairs[new] += right
            pairs[:, new] += left
            pairs[new, new] += self_
            class_out[new] += out[w]
            class_in[new] += in_[w]
            if new != old:
                moved += 1
                of[w] = new
                after[:, old] -= counts[:, w]
                after[:, new] += counts[:, w]
                before[:, old] -= counts[w]
                before[:, new] += counts[w]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """A trained model: what tasks need to score texts, but for the counts and classes of rare words."""

    tokens: int  # N: training tokens
    distinct: int  # V
    words: np.ndarray  # hashes of the words in memory, sorted
    log_count: np.ndarray  # log10(count + 1) of these
    own: int  # types up to here are these words, then come the suffixes of unseen words
    class_of: np.ndarray  # of each type
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of each type
    divisor: np.ndarray  # log10 of what divides count + 1 in P(word | class), by class
    rare: DataFrame | None = None  # (word, n, class) of all other words; stays with the driver

    def __getstate__(self):
        return self.__dict__ | {"rare": None}

    def types(self, token: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Type of each token, its place in the table, and whether it is in the table."""
        place, known = _places(self.words, token)
        return np.where(known, place, self.own + suffix), place, known


def _places(words: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(token, return_inverse=True)
    place = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
    return place[at], (words[place] == distinct)[at]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as binary values; ``bounds`` are the places where they begin and end."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _encoded(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(types, rare)`` of each text: per token its place in ``words``, or after these its suffix (int32), and the hashes of
    the latter in order. Texts are taken apart once for all rounds."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=CHUNK_BYTES):
            token, suffix, _, ends = _tokens([t or b"" for t in texts(batch)])
            place, known = _places(shared.value, token)
            types = np.where(known, place, len(shared.value) + suffix).astype(np.int32)
            bounds = np.concatenate(([0], ends + 1))
            rare = np.concatenate(([0], np.cumsum(~known)))[bounds]
            yield pa.RecordBatch.from_arrays([_binary(types, bounds), _binary(token[~known], rare)], ["types", "rare"])

    return materialise(shipped(docs.select("text")).mapInArrow(encode, "types binary, rare binary"), "encoded")


def _flat(batch: pa.RecordBatch, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype)


def _matrix(pairs: DataFrame, size: int) -> np.ndarray:
    """Counts ``(pair, n)`` of a bounded number of pairs as a matrix."""
    table = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size, np.int64)
    matrix[table["pair"].to_numpy()] = table["n"].to_numpy()
    return matrix.reshape(size, size)


def _bigrams(encoded: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of bigrams of what ``of`` says of each type; types with a negative one are left out.

    Every text ends with an end and begins after one, so the texts of a slice are read as one ring.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in slices(batches, "types", CHUNK_BYTES):
            kind = shared.value[_flat(batch, "types", np.int32)].astype(np.int64)
            before = np.roll(kind, 1)
            total += np.bincount((before * size + kind)[(kind >= 0) & (before >= 0)], minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return _matrix(shipped(encoded).mapInArrow(count, "pair bigint, n bigint"), size)


def best_classes(pairs: np.ndarray, owner: np.ndarray, key: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams most, all other words staying.

    ``pairs`` are the counts of class bigrams. Word ``owner[i]`` (of class ``old[owner[i]]``) has ``n[i]`` neighbours of
    one class: class ``key[i]`` before it, or ``key[i] - classes`` after it. Every word needs an entry.
    """
    classes = len(pairs)
    cell = np.concatenate((pairs, pairs.T)).astype(float)
    class_n = pairs.sum(axis=0).astype(float)
    best = np.empty(len(old), np.int64)
    code, at = np.unique(owner * (2 * classes) + key, return_inverse=True)
    n = np.bincount(at, n)
    owner, key = np.divmod(code, 2 * classes)
    first = np.concatenate((np.searchsorted(owner, np.arange(0, len(old), CHUNK_CHOICES)), [len(owner)]))
    for low, high in zip(first[:-1], first[1:], strict=True):
        word, many = owner[low:high], n[low:high]
        value = cell[key[low:high]]
        value[np.arange(len(word)), old[word]] -= many  # as if the word were in no class
        gain = np.add.reduceat(_f(value + many[:, None]) - _f(value), np.flatnonzero(np.diff(word, prepend=-1)))
        here = np.arange(word[0], word[-1] + 1)
        size = np.bincount(word - word[0], many * (key[low:high] < classes))
        others = np.tile(class_n, (len(here), 1))
        others[np.arange(len(here)), old[here]] -= size
        gain -= 2 * (_f(others + size[:, None]) - _f(others))
        gain[:, class_n == 0] = -np.inf  # where all words with like neighbours would meet
        stay = gain[np.arange(len(here)), old[here]]
        best[here] = np.where(gain.max(axis=1) > stay + 1e-9, gain.argmax(axis=1), old[here])
    return best


def _exchanged(encoded: DataFrame, words: np.ndarray, class_of: np.ndarray, classes: int, half: int) -> np.ndarray:
    """Classes after one round of exchange for the words in memory, by their neighbours' classes in the texts.

    Words move at once, but only every second one in a round, so that neighbours seldom move together.
    """
    pairs = _bigrams(encoded, class_of, classes)
    moves = np.concatenate((mixed(words) % np.uint64(2) == half, np.zeros(SUFFIX_TYPES, bool)))
    shared = encoded.sparkSession.sparkContext.broadcast((class_of, moves))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, n = (np.concatenate(c) for c in zip(*held, strict=True))
            distinct, at = np.unique(code, return_inverse=True)
            return distinct, np.bincount(at, n).astype(np.int64)

        def batch_of(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            place, key = np.divmod(code, 2 * classes)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            bounds = pa.array(np.append(first, len(place)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (key.astype(np.int16), n)]
            return pa.RecordBatch.from_arrays([pa.array(place[first].astype(np.int32)), *lists], ["place", "key", "n"])

        of, moving = shared.value
        for batch in slices(batches, "types", CHUNK_BYTES):
            types = _flat(batch, "types", np.int32)
            kind = of[types]
            at = np.flatnonzero(moving[types])
            code = types[at].astype(np.int64) * (2 * classes)
            found = np.concatenate((code + np.roll(kind, 1)[at], code + classes + np.roll(kind, -1)[at]))
            distinct, n = np.unique(found, return_counts=True)
            held.append((distinct, n))
            waiting += len(distinct)
            if waiting > FLUSH_WORDS:
                held = [merged()]
                waiting = len(held[0][0])
                if waiting > FLUSH_WORDS // 2:
                    yield batch_of(*held[0])
                    held, waiting = [], 0
        if waiting:
            yield batch_of(*merged())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            seen = batch.column("seen")
            parts = seen.flatten()
            key, n = parts.field("key"), parts.field("n")
            owner = np.repeat(np.repeat(np.arange(len(place)), seen.value_lengths().to_numpy()), key.value_lengths().to_numpy())
            best = best_classes(pairs, owner, key.flatten().to_numpy(), n.flatten().to_numpy(), shared.value[0][place].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(best.astype(np.int16))], ["place", "class"])

    found = shipped(encoded).mapInArrow(neighbours, "place int, key array<smallint>, n array<bigint>")
    listed = found.groupBy("place").agg(F.collect_list(F.struct("key", "n")).alias("seen"))
    chosen = listed.mapInArrow(choose, "place int, class smallint").toArrow()
    new = class_of.copy()
    new[chosen["place"].to_numpy()] = chosen["class"].to_numpy()
    return new


def _rare_classes(encoded: DataFrame, class_of: np.ndarray, own: int, classes: int) -> tuple[DataFrame, np.ndarray]:
    """``(word, n, class)`` of all words that are not in memory, and the class bigrams of all training tokens.

    They come last, as in Brown's order of frequency: each joins the class that raises the likelihood most, given
    the classes of its neighbours, of which those that are rare themselves still count with their suffix.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(class_of)
    pairs = _bigrams(encoded, class_of, classes)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "types", CHUNK_BYTES):
            types, word = _flat(batch, "types", np.int32), _flat(batch, "rare", np.int64)
            kind, rare = shared.value[types], types >= own
            at = np.flatnonzero(rare)
            after_rare = np.roll(rare, 1)[at]
            columns = [
                pa.array(word), pa.array(kind[at].astype(np.int16)), pa.array(np.roll(kind, 1)[at].astype(np.int16)), pa.array(np.roll(kind, -1)[at].astype(np.int16)),
                pa.array(np.roll(word, 1), mask=~after_rare), pa.array(np.roll(rare, -1)[at]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "seed", "before", "after", "previous", "next_rare"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = batch.column("before"), batch.column("after")
            n = before.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            key = np.concatenate((before.flatten().to_numpy(), after.flatten().to_numpy() + classes)).astype(np.int64)
            best = best_classes(pairs, np.concatenate((owner, owner)), key, np.ones(len(key)), batch.column("seed").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int16))], ["word", "n", "class"])

    schema = "word bigint, seed smallint, before smallint, after smallint, previous bigint, next_rare boolean"
    found = shipped(encoded.filter("length(rare) > 0")).mapInArrow(tokens, schema)
    listed = found.groupBy("word").agg(F.first("seed").alias("seed"), F.collect_list("before").alias("before"), F.collect_list("after").alias("after"))
    rare = materialise(listed.mapInArrow(choose, "word bigint, n bigint, class smallint"), "rare")
    one = rare.select("word", F.col("class").cast("bigint").alias("class"))
    named = materialise(found.drop("seed").join(one, "word").drop("word"), "named")
    both = named.filter("previous IS NOT NULL").join(one.select(F.col("word").alias("previous"), F.col("class").alias("one_before")), "previous")
    pair = lambda rows, a, b: rows.select((F.col(a) * classes + F.col(b)).alias("pair"), F.lit(1).alias("n"))
    with_rare = (
        pair(named.filter("previous IS NULL"), "before", "class").unionAll(pair(named.filter("NOT next_rare"), "class", "after"))
        .unionAll(pair(both, "one_before", "class"))
    )
    return rare, _bigrams(encoded, np.where(np.arange(len(class_of)) < own, class_of, -1), classes) + _matrix(with_rare, classes)


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what does not depend on the classes."""
    pairs = pairs.astype(float)
    return float(_f(pairs).sum() - _f(pairs.sum(axis=0)).sum() - _f(pairs.sum(axis=1)).sum())


def train(
    docs: DataFrame, classes: int = CLASSES, own_share: float = OWN_SHARE, table_share: float = TABLE_SHARE, rounds: int = ROUNDS
) -> ClassModel | None:
    """Learn from all texts of ``docs`` (null: empty); None without any document."""
    counts = materialise(word_counts(docs), "counts")
    totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    if not totals["distinct"]:
        return None
    tokens, distinct = totals["tokens"], totals["distinct"]
    end = int(END.astype(np.int64))
    frequent = (F.col("n") >= tokens * table_share) | (F.col("word") == end)
    table = counts.filter(frequent).toArrow()
    word, n, suffix = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["suffix"].to_numpy()
    order = np.argsort(word)
    word, n, suffix = word[order], n[order], suffix[order].astype(np.int64)
    encoded, own = _encoded(docs, word), len(word)
    # The driver's exchange, of frequent words and suffixes, is where the words begin.
    is_type = (n >= tokens * own_share) | (word == END)
    types = int(is_type.sum())
    type_of = np.concatenate((types + suffix, types + np.arange(SUFFIX_TYPES)))
    type_of[:own][is_type] = np.arange(types)
    class_of = exchange(_bigrams(encoded, type_of, types + SUFFIX_TYPES), classes)[type_of].astype(np.int16)
    still = 0
    for round_ in range(rounds):
        new = _exchanged(encoded, word, class_of, classes, round_ % 2)
        still, class_of = 0 if (new != class_of).any() else still + 1, new
        if still == 2:
            break
    rare, pairs = _rare_classes(encoded, class_of, own, classes)
    class_n = pairs.sum(axis=0).astype(float)
    frequency = (class_n + 1) / (class_n.sum() + classes)
    follows, out = (pairs > 0).sum(axis=1), pairs.sum(axis=1)
    share = np.where(out > 0, follows / np.maximum(follows + out, 1), 1.0)[:, None]  # Witten and Bell's
    transition = (1 - share) * pairs / np.maximum(out, 1)[:, None] + share * frequency
    # One more word for each suffix, which stands for its unseen words.
    members = np.bincount(class_of, minlength=classes)
    for row in rare.groupBy("class").count().collect():  # one row per class
        members[row["class"]] += row["count"]
    divisor = np.log10(np.maximum(class_n + members, 1))
    log_count = np.log10(n + 1.0)
    emission = np.concatenate((log_count, np.zeros(SUFFIX_TYPES))) - divisor[class_of]
    return ClassModel(tokens, distinct, word, log_count, own, class_of, np.log10(transition), emission, divisor, rare)


def score(docs: DataFrame, model: ClassModel) -> DataFrame:
    """Scores of all whole texts: ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    ``base_score`` is the add-one unigram's log10 probability, ``score`` the class model's; a null text is empty and has
    one token, its end. ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per rare token; a text's first row, or a row of its own that counts nothing, carries all other sums."""
        m = shared.value
        next_row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, size=CHUNK_BYTES):
            docs_here = batch.num_rows
            token, suffix, text, ends = _tokens([t or b"" for t in texts(batch)])
            type_, place, known = m.types(token, suffix)
            class_ = m.class_of[type_]
            before, after = np.roll(class_, 1), np.roll(class_, -1)
            log_count = np.where(known, m.log_count[place], 0.0)
            value = np.where(known, m.emission[type_], 0.0) + np.where(known & np.roll(known, 1), m.transition[before, class_], 0.0)
            per = lambda x: np.bincount(text, x, minlength=docs_here)
            n, n_known, base, model_score = np.bincount(text, minlength=docs_here), per(known).astype(np.int64), per(log_count), per(value)
            rare = np.flatnonzero(~known)
            none = np.setdiff1d(np.arange(docs_here), text[rare])
            t = np.concatenate((text[rare], none))
            fill = lambda values, empty: np.concatenate((values[rare], np.full(len(none), empty, values.dtype)))
            w = np.concatenate((token[rare], mixed(none.astype(np.uint64) + np.uint64(next_row))))
            _, lead = np.unique(t, return_index=True)  # the row that carries its text's sums
            carries = np.zeros(len(t), bool)
            carries[lead] = True
            rows = next_row + t
            next_row += docs_here
            only = lambda values: pa.array(values[t], mask=~carries)
            small = lambda values, missing: pa.array(fill(values, 0).astype(np.int16), mask=missing)
            absent = np.arange(len(t)) >= len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), batch.column("doc_id").take(pa.array(np.where(carries, t, 0), mask=~carries)), pa.array(w.view(np.int64)),
                    pa.array(fill(np.arange(len(token)), 0)), small(class_, absent),
                    small(before, absent | fill(~np.roll(known, 1), True)), small(after, absent | fill(~np.roll(known, -1), True)),
                    only(n), only(n_known), only(base), only(model_score),
                ],
                ["row", "doc_id", "word", "at", "unseen_class", "before", "after", "n_tokens", "n_known", "base", "score"],
            )

    field, long, short, double = T.StructField, T.LongType(), T.ShortType(), T.DoubleType()
    schema = T.StructType([
        field("row", long), field("doc_id", docs.schema["doc_id"].dataType), field("word", long), field("at", long), field("unseen_class", short),
        field("before", short), field("after", short), field("n_tokens", long), field("n_known", long), field("base", double), field("score", double),
    ])
    parts = shipped(docs.select("doc_id", "text")).mapInArrow(sums, schema)
    joined = parts.join(model.rare, "word", "left").withColumn("class", F.when(F.col("unseen_class").isNotNull(), F.coalesce("class", "unseen_class")))
    # A rare token after a rare one has its neighbour in the row before.
    named = joined.withColumn("before", F.coalesce("before", F.lag("class").over(Window.partitionBy("row").orderBy("at"))))
    classes = len(model.transition)
    into = spark.createDataFrame(pa.table({"into": np.arange(classes * classes), "step_in": (model.transition - model.divisor).ravel()}))
    out_of = spark.createDataFrame(pa.table({"out_of": np.arange(classes * classes), "step_out": model.transition.ravel()}))
    stepped = (
        named.withColumn("into", F.col("before").cast("bigint") * classes + F.col("class"))
        .withColumn("out_of", F.col("class").cast("bigint") * classes + F.col("after"))
        .join(F.broadcast(into), "into", "left").join(F.broadcast(out_of), "out_of", "left")
    )
    none = F.lit(0.0)
    logs = F.sum(F.when(F.col("class").isNotNull(), F.log10(F.coalesce("n", F.lit(0)) + 1.0)).otherwise(none))
    known = F.sum(F.when(F.col("class").isNotNull() & F.col("n").isNotNull(), 1).otherwise(0))
    summed = stepped.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"),
        F.max("base").alias("base"), F.max("score").alias("score"), logs.alias("logs"), known.alias("known"),
        F.sum(F.coalesce("step_in", none) + F.coalesce("step_out", none)).alias("steps"),
    )
    divisor = math.log10(model.tokens + model.distinct + 1)
    return summed.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("score") + F.col("logs") + F.col("steps")).alias("score"),
    )


def perplexity(tokens: DataFrame) -> DataFrame:
    """Add ``perplexity`` to scored documents: 10 to the mean negative log10 probability of a token."""
    return tokens.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """Train on all folds but one and score every document, with ``held_out``.

    The fold is crc32 of the id as text. If no document is left to learn from, an empty text is learnt from.
    """
    fold = fold_crc("doc_id", folds)
    learnt = docs.filter(fold != held)
    model = train(learnt, **options) or train(docs.sparkSession.createDataFrame([("",)], "text string"), **options)
    scored = score(docs, model)
    return scored.select("doc_id", (fold_crc("doc_id", folds) == held).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])
