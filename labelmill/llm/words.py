"""Words of texts as 64-bit hashes, many texts at a time.

Two different words have equal hashes with a probability of 2**-64; what is counted by hash is exact but for that.
"""

from __future__ import annotations

import numpy as np

# Bytes of text whose hashes are computed together.
CHUNK_BYTES = 1 << 21

_random = np.random.default_rng(20240517)
_BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
for _i in range(65, 91):
    _BYTE[_i] = _BYTE[_i + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FACTOR = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Runs of ASCII letters and of all bytes of other characters: what is left when digits and ASCII punctuation go.
NOT_LETTERS = np.array([not chr(b).isalpha() if b < 128 else False for b in range(256)])


def word_hashes(text: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every word, A-Z lower-cased; long texts in chunks that end between words.

    ``between`` tells for each byte whether it separates words.
    """
    hashes, starts, lengths, at, n = [], [], [], 0, len(text)
    while at < n:
        end = min(at + CHUNK_BYTES, n)
        while end < n and not between[text[end]]:
            end += 1
        raw = np.frombuffer(text, np.uint8, end - at, at)
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = between[raw]
        first = np.flatnonzero(space[:-2] & ~space[1:-1])
        length = np.flatnonzero(~space[1:-1] & space[2:]) + 1 - first
        if len(first):
            which = np.flatnonzero(~space[1:-1])  # the words' bytes
            begins = np.concatenate(([0], np.cumsum(length)[:-1]))
            place = np.arange(len(which)) - np.repeat(begins, length)
            powers = np.cumprod(np.full(int(length.max()), BASE, np.uint64))
            values = np.add.reduceat(_BYTE[raw[which]] * powers[place], begins)
            hashes.append(mixed(values + length.astype(np.uint64)))
            starts.append(first + at)
            lengths.append(length)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths)


def words_of(batch: list[bytes], between: np.ndarray = _SPACE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, hash, start and length of each word, and where each text's words begin and end."""
    joined = b" ".join(batch)
    hashes, starts, lengths = word_hashes(joined, between)
    ends = np.cumsum([len(t) + 1 for t in batch])
    return joined, hashes, starts, lengths, np.concatenate(([0], np.searchsorted(starts, ends)))
