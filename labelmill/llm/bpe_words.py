"""Words of texts that a byte-level tokenizer encodes independently of each other, as Arrow arrays.

The pre-tokenizer's pattern reads from left to right and never looks back. Its alternatives are runs of letters, of
digits and of other characters, each with at most one space before it, contractions (``'s``) and runs of white space.
So a match always begins

* at an ASCII white space after a character that is none,
* between ASCII characters of different kinds (letter, digit, other), unless the first is an apostrophe,
* after a single tab or line break that stands between two other characters, and
* at both ends of a special string, which the library takes out before anything else.

A text cut at these places is a list of words whose ids, joined, are the ids of the text. Beside other characters than
ASCII and Latin-1 letters nothing is cut, so no answer depends on the edition of Unicode.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from labelmill.llm.tokens import load

# Words that a worker's table may hold (each counted with its bytes / 100), and new words that are encoded as one text.
TABLE_WORDS = 500_000
JOINED_WORDS = 100

_SPACE, _BREAK, _RETURN, _LETTER, _DIGIT, _SIGN, _APOSTROPHE = range(1, 8)
KIND = np.zeros(256, np.uint8)
for _b in range(33, 127):
    KIND[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _SIGN
KIND[[9, 10]], KIND[13], KIND[32], KIND[39] = _BREAK, _RETURN, _SPACE, _APOSTROPHE

# For each pair of neighbours' kinds, whether a word begins at the second.
_STARTS = np.zeros((8, 8), bool)
_STARTS[_LETTER:, _SPACE : _RETURN + 1] = True
for _a, _others in ((_LETTER, (_DIGIT, _SIGN, _APOSTROPHE)), (_DIGIT, (_LETTER, _SIGN, _APOSTROPHE)), (_SIGN, (_LETTER, _DIGIT))):
    _STARTS[_a, list(_others)] = True
_STARTS = _STARTS.reshape(-1)


def special_strings(tokenizer) -> re.Pattern | None:
    """A pattern of the tokenizer's special strings; raises if the tokenizer isn't of the kind described above."""
    how = repr(tokenizer.pre_tokenizer)
    if tokenizer.normalizer is not None or not how.startswith("ByteLevel(add_prefix_space=False") or "use_regex=True" not in how:
        raise ValueError(f"not a plain byte-level tokenizer: {how}")
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("special strings that take neighbours with them are not supported")
    names = sorted((t.content.encode() for t in added), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, names))) if names else None


def words(batch: list[bytes], special: re.Pattern | None, never: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order (views of the joined texts), and where each text's words begin and end.

    ``never`` marks pairs of kinds (``8 * first + second``) between which no word may begin, for another tokenizer's sake.
    """
    joined = b"".join(batch)
    ends = np.cumsum([len(t) for t in batch], dtype=np.int64)
    n = len(joined)
    starts = np.zeros(n + 1, bool)
    if n:
        raw = np.frombuffer(joined, np.uint8)
        kind = KIND[raw]
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        starts[1:n] = _STARTS[pair]
        white = (kind[1:] >= _SPACE) & (kind[1:] <= _RETURN)
        starts[2:n] |= white[1:] & (raw[:-2] == 0xC3) & (raw[1:-1] >= 0x80)
        starts[2:n] |= (kind[:-2] >= _LETTER) & (kind[1:-1] >= _BREAK) & (kind[1:-1] <= _RETURN) & (kind[2:] >= _LETTER)
        if never is not None:
            starts[1:n] &= ~never[pair]
        if special is not None:
            held = batch if special.search(joined) else []
            for text, end in zip(held, ends.tolist(), strict=False):
                for found in special.finditer(text):
                    first, last = end - len(text) + found.start(), end - len(text) + found.end()
                    starts[first + 1 : last] = False
                    starts[[first, last]] = True
    starts[ends], starts[0] = True, True
    places = np.flatnonzero(starts[:n]).astype(np.int32)
    offsets = np.append(places, np.int32(n)) if n else np.zeros(1, np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return array, np.concatenate(([0], np.searchsorted(places, ends)))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


class WordTable:
    """Ids of words, each encoded once while it is held. Words met in several batches outlive a full table."""

    def __init__(self, tokenizer):
        self.tokenizer, self.special = tokenizer, special_strings(tokenizer)
        self.line_feed = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.ends, self.uses = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int32)
        self.held = 0.0

    def shrink(self) -> None:
        """Keep the words that were met in more than one batch, if these are less than half of the table, or else none."""
        kept, names = np.flatnonzero(self.uses > 1), list(self.index)
        lengths = np.diff(self.ends)[kept]
        ids = gather(self.ids, self.ends[kept], lengths)
        few = 2 * len(kept) < len(names)
        self.clear()
        if few:
            self.index = {names[i]: k for k, i in enumerate(kept.tolist())}
            self.ids, self.ends, self.uses = ids, np.concatenate(([0], np.cumsum(lengths))), np.ones(len(kept), np.int32)
            self.held = len(kept) + sum(map(len, self.index)) / 100

    def _learn(self, new: list[bytes]) -> None:
        plain, odd = [], []
        for word in new:
            t = word.decode()
            free = not t[0].isspace() or (t[0] == " " and len(t) > 1 and not t[1].isspace())
            (plain if free and not t[-1].isspace() and "\n" not in t else odd).append(t)
        # A line feed between two of the plain words is a word of its own.
        groups = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        parts, lengths = [], []
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, np.int32)
            breaks = np.flatnonzero(ids == self.line_feed)
            if len(breaks) != len(group) - 1:
                raise ValueError("the tokenizer doesn't keep line feeds apart")
            parts.append(np.delete(ids, breaks))
            lengths.append(np.diff(breaks, prepend=-1, append=len(ids)) - 1)
        for encoding in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False):
            parts.append(np.array(encoding.ids, np.int32))
            lengths.append(np.array([len(encoding.ids)]))
        first = len(self.index)
        self.index.update({t.encode(): first + i for i, t in enumerate([*plain, *odd])})
        self.ids = np.concatenate([self.ids, *parts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.held += len(new) + sum(map(len, new)) / 100

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end."""
        if self.held > TABLE_WORDS:
            self.shrink()
        found, bounds = words(batch, self.special)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        self.uses[place] += 1
        place = place[coded.indices.to_numpy()]
        lengths = self.ends[place + 1] - self.ends[place]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        return gather(self.ids, self.ends[place], lengths), upto[bounds]


@lru_cache(maxsize=2)
def word_table(tokenizer_file: str) -> WordTable:
    """One table a process, so that the tasks of a worker share it."""
    return WordTable(load(tokenizer_file))
