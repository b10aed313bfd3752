"""Functions over teacher replies: fenced JSON, JSON spans and sample extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions.text import long_enough, plain_line, strip, unquote

_STRICT = {"allowSingleQuotes": "false"}


def strip_fence(c: Column) -> Column:
    """Text after the first ```` ```json ```` fence and up to the next fence.

    With only a plain fence the part *before* it is kept, which is usually empty.
    """
    start = F.locate("```json", c)
    opened = F.when(start > 0, F.substring(c, start + F.lit(7), F.length(c))).otherwise(c)
    return strip(F.substring_index(opened, "```", 1))


def json_span(c: Column) -> Column:
    """Substring from the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def one_json_value(c: Column) -> Column:
    """True if the text is exactly one JSON value; ``from_json`` alone ignores what follows the first."""
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    return F.coalesce(F.json_array_length(wrapped) == 1, F.lit(False))


def parse_object(c: Column, value_type: str) -> Column:
    """JSON object text to a map; null if it is malformed."""
    return F.when(one_json_value(c), F.from_json(c, f"map<string,{value_type}>", _STRICT))


def last_entries(m: Column) -> Column:
    """Entries of a parsed map with duplicate keys resolved to the last one, as ``(key, at, value)``.

    Sorting inside the row keeps this O(n log n) for long objects.
    """
    numbered = F.transform(
        F.map_entries(m), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))
    )
    ordered = F.sort_array(numbered)
    # Each entry is paired with its successor; a lambda that named the array would evaluate it per element.
    after = F.slice(ordered, F.lit(2), F.size(ordered))
    pairs = F.arrays_zip(ordered.alias("e"), after.alias("next"))
    last = F.filter(pairs, lambda x: x["next"].isNull() | (x["next"]["key"] != x["e"]["key"]))
    return F.transform(last, lambda x: x["e"])


def sample_texts(c: Column, n: int = 10) -> Column:
    """Array of sample texts found in one reply.

    A reply with braces is read as one JSON object (malformed: no samples). Without
    braces, numbered ``"1": "text"`` pairs are taken; without those, one sample per line.
    """
    has_object = F.contains(c, F.lit("{")) & F.contains(c, F.lit("}"))
    entries = last_entries(parse_object(json_span(c), "string"))
    in_order = F.sort_array(F.transform(entries, lambda e: F.struct(e["at"], e["value"])))
    values = F.transform(in_order, lambda e: unquote(e["value"]))
    from_json = F.filter(values, lambda v: long_enough(v, n))
    # Fixed value: the pattern of a numbered pair.
    pairs = F.regexp_extract_all(c, F.lit(r'"(\d+)"\s*:\s*"([^"]*)"'), 2)
    from_pairs = F.filter(pairs, lambda v: (v != "") & ~v.endswith("\\"))
    lines = F.transform(F.split(strip(c), "\n"), lambda v: strip(unquote(v)))
    from_lines = F.filter(lines, lambda v: plain_line(v, n))
    return F.when(has_object, from_json).when(F.size(pairs) > 0, from_pairs).otherwise(from_lines)
