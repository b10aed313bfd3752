"""Scalar text functions: cleaning, quoting, truncation, keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Punctuation that the sequence tokenizer turns into spaces (the apostrophe stays).
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# Words dropped from a problem description before it becomes a model name.
SLUG_STOP_WORDS = ("classification", "classify", "analysis", "analyze", "of", "for", "the", "a", "an")

# A word token is two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

_SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE_RUN = f"[{_SPACE_CLASS}]+"


def strip(c: Column) -> Column:
    """Remove white space, including the non-ASCII kinds, from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Null to empty, white-space runs to one space, doubled quotes to one, trimmed."""
    one_line = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _SPACE_RUN, " ")
    return F.trim(F.replace(one_line, F.lit('""'), F.lit('"')))


def unquote(c: Column) -> Column:
    """Strip white space, then the double quotes around the text."""
    return F.trim(strip(c), F.lit('"'))


def norm_key(c: Column) -> Column:
    """Key under which two texts count as duplicates."""
    return F.lower(strip(c))


def key_digest(c: Column) -> Column:
    """256-bit digest of the duplicate key: what gets shuffled instead of whole texts."""
    return F.unhex(F.sha2(norm_key(c), 256))


def ellipsis(c: Column, n: int, mode: str = "cut") -> Column:
    """First ``n`` characters. ``cut`` appends dots only to shortened texts, ``always`` and ``never`` as named."""
    head = F.substring(c, 1, n)
    if mode == "cut":
        return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(c)
    if mode == "always":
        return F.concat(head, F.lit("..."))
    if mode == "never":
        return head
    raise ValueError(f"unknown mode {mode!r}")


def slug(c: Column, default: str = "user_dataset") -> Column:
    """Snake-case model name of at most 30 characters from a free-text description."""
    words = F.regexp_replace(F.lower(c), r"(?U)\b(?:" + "|".join(SLUG_STOP_WORDS) + r")\b", "")
    kept = F.regexp_replace(words, rf"[^\p{{L}}\p{{N}}_{_SPACE_CLASS}]", "")
    joined = F.regexp_replace(F.regexp_replace(strip(kept), _SPACE_RUN, "_"), "_+", "_")
    name = F.substring(F.trim(joined, F.lit("_")), 1, 30)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def split_labels(c: Column) -> Column:
    """Comma-separated label string to an array of trimmed, non-empty labels."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def first_label(c: Column) -> Column:
    """First comma part of a label string, untrimmed."""
    return F.substring_index(c, ",", 1)


def multi_hot(c: Column, labels: list[str]) -> Column:
    """Array of 0/1 floats, one per entry of ``labels``."""
    parts = split_labels(c)
    return F.array(*[F.array_contains(parts, x).cast("float") for x in labels])


def tokenize(c: Column) -> Column:
    """Lower-cased word tokens for TF-IDF."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), 0)


def sequence_tokens(c: Column) -> Column:
    """Lower-cased tokens for id sequences: punctuation to spaces, split on the space character."""
    spaced = F.translate(F.lower(c), SEQUENCE_FILTERS, " " * len(SEQUENCE_FILTERS))
    return F.array_remove(F.split(spaced, " "), "")


def long_enough(c: Column, n: int = 10) -> Column:
    """Minimum-length test for a generated sample."""
    return F.length(c) >= n


def plain_line(c: Column, n: int = 10) -> Column:
    """Minimum-length test for a line of a non-JSON reply: braces at the ends are rejected too."""
    return long_enough(c, n) & ~c.startswith("{") & ~c.endswith("}")


def is_correct(label: Column, predicted: Column) -> Column:
    """Exact match; a null on either side counts as wrong."""
    return F.coalesce(label == predicted, F.lit(False))
