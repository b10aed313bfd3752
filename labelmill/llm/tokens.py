"""Token counts and ids of whole texts, as the tokenizers library gives them.

Two exact shortcuts make this fast and bounded:

* **Units.** A byte-level pre-tokenizer always starts a new word at a space that follows a character other than
  white space, and such a space with a character other than white space after it belongs to the word it starts. A
  text cut before these spaces is therefore a list of units that the library encodes independently of each other;
  each distinct unit is encoded once per task (the table of units is emptied when it grows too large).
* **Overlap resynchronisation** for huge texts. Chunks on a fixed grid, each overlapping the next, are encoded
  with offsets. The pre-tokenizer reads from left to right and looks ahead one character, never back; so where two
  neighbours both start a word at the same place, the right one goes on as the whole text would. Word starts near
  the left chunk's end do not count, because a word or special string may have been cut there. If two neighbours
  share no proven start, the right chunk begins earlier, twice as far each time, at last where the left one began.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelmill.llm.common import shipped, slices, texts

# Texts of more characters than this are encoded in overlapping chunks.
HUGE_CHARS = 32_768
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 256

# A word start this close to the end of a chunk is not proven (the longest special string has 13 characters).
MARGIN_CHARS = 32

# Characters that the table of units may hold; each unit counts as 100 more.
TABLE_CHARS = 60_000_000

# New units that are encoded together, and how a byte-level vocabulary writes a space.
JOINED_UNITS = 1_000
_SPACE_BYTE = "\u0120"

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"(?<!\S) | (?!\S)")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per process. ``path`` may name a file of the public collection."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


class Units:
    """Encodes texts unit by unit and keeps each unit's ids (little-endian, four bytes each) or only their number."""

    def __init__(self, tokenizer, counts_only: bool = False):
        self.tokenizer, self.counts_only = tokenizer, counts_only
        self.first: dict[str, bytes | int] = {}
        self.later: dict[str, bytes | int] = {}
        self.held = 0
        # Ids whose token begins with a space: in units joined by spaces, the first id of each.
        vocabulary = tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE_BYTE)]] = True

    def _learn(self, table: dict[str, bytes | int], wanted: set[str], prefix: str) -> None:
        new = list(wanted.difference(table))
        self.held += sum(map(len, new)) + 100 * len(new)
        plain = [u for u in new if u and " " not in u and not u[0].isspace() and not u[-1].isspace()] if prefix == " " else []
        # Units of this kind are independent of each other in one text, and one text costs less than many.
        groups = [plain[i : i + JOINED_UNITS] for i in range(0, len(plain), JOINED_UNITS)]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, "<u4")
            bounds = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(bounds) != len(group) + 1 or bounds[0]:
                raise ValueError("the tokenizer doesn't begin a token at each space")
            if self.counts_only:
                table.update(zip(group, np.diff(bounds).tolist(), strict=True))
            else:
                raw, places = ids.tobytes(), (4 * bounds).tolist()
                table.update(zip(group, (raw[a:b] for a, b in pairwise(places)), strict=True))
        odd = [u for u in new if u not in table]
        for unit, encoding in zip(odd, self.tokenizer.encode_batch_fast([prefix + u for u in odd], add_special_tokens=False), strict=True):
            table[unit] = len(encoding) if self.counts_only else np.array(encoding.ids, "<u4").tobytes()

    def encode(self, batch: list[str]) -> Iterator[Iterator[bytes | int]]:
        """For each text, the values of its units in order."""
        if self.held > TABLE_CHARS:
            self.first.clear()
            self.later.clear()
            self.held = 0
        units = [_CUT.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in batch]
        heads = [u.pop(0) for u in units]
        self._learn(self.first, set(heads), "")
        self._learn(self.later, set(chain.from_iterable(units)), " ")
        later = self.later.__getitem__
        for head, rest in zip(heads, units, strict=True):
            yield chain((self.first[head],), map(later, rest))


def _word_starts(encoding, start: int) -> dict[int, int]:
    """Place of each word start in the whole text, with the number of tokens before it in the chunk."""
    words, offsets = encoding.word_ids, encoding.offsets
    return {start + offsets[i][0]: i for i in range(len(words)) if not i or words[i] != words[i - 1]}


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN_CHARS) -> Iterator[list[int]]:
    """Ids of a text in pieces, from overlapping chunks spliced at proven word starts; equal to encoding it whole."""
    if len(text) <= chunk:
        yield tokenizer.encode(text, add_special_tokens=False).ids
        return
    grid = range(0, len(text) - overlap, chunk - overlap)
    encoded = iter(tokenizer.encode_batch([text[s : s + chunk] for s in grid], add_special_tokens=False))
    left, left_start, left_end = next(encoded), 0, chunk
    done = 0  # tokens of the left chunk that are not wanted or already given
    for start in grid[1:]:
        right, end = next(encoded), min(start + chunk, len(text))
        starts, width = _word_starts(left, left_start), overlap
        while True:
            last = left_end - margin
            common = [p for p in _word_starts(right, start).keys() & starts.keys() if p <= last and starts[p] >= done]
            if common:
                at = max(common)
                yield left.ids[done : starts[at]]
                left, done = right, _word_starts(right, start)[at]
                left_start, left_end = start, end
                break
            width *= 2
            start = max(left_end - width, left_start)
            right = tokenizer.encode(text[start:end], add_special_tokens=False)
            if start == left_start:  # nothing in the left chunk is proven: the right one takes its place
                left, left_end = right, end
                break
    yield left.ids[done:]


def count_texts(tokenizer_file: str, huge: int = HUGE_CHARS) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of a list of texts."""
    tokenizer = load(tokenizer_file)
    units = Units(tokenizer, counts_only=True)

    def counts(batch: list[str]) -> list[int]:
        short = units.encode([t for t in batch if len(t) <= huge])
        return [sum(next(short)) if len(t) <= huge else sum(map(len, spliced_ids(tokenizer, t))) for t in batch]

    return counts


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, huge: int = HUGE_CHARS) -> DataFrame:
    """Tokens of every whole text: ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is empty and has 0 tokens. Strings
    of special tokens inside a text are handled as the library's default does (as the special token).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count_texts(tokenizer_file, huge)
        for batch in slices(batches):
            raw = [t or b"" for t in texts(batch)]
            n = counts([t.decode() for t in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ])
    return shipped(docs.select("doc_id", "text")).mapInArrow(count, schema)
