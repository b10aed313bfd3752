"""Secret scans: plain patterns, and literals assigned to names that tell of secrets.

The lexer reads what source code and configuration files have in common: a name (bare, quoted, dotted or an
index), an assignment sign, and a value: a quoted literal (adjacent ones joined by ``+``), a bare literal as in
``KEY=value`` files, or another name. Values that are names are followed through the text's own assignments, so a
constant counts under every name that it reaches. A literal's score is the sensitivity of the most telling of these
names times how much the literal looks like a secret; literals above a limit become spans of kind ``literal``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelmill.llm.common import shipped, slices, texts, tidied

Span = tuple[str, int, int]

# Fixed values of the contract: the kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

# How strongly a word within a name tells of a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "token": 0.9, "pass": 0.8, "bearer": 0.8, "authorization": 0.8, "auth": 0.7, "signature": 0.6, "salt": 0.6,
    "pin": 0.5, "key": 0.4,
}
# Words that make a neighbouring ``key`` as telling as a secret, and words that say the value is none.
KEY_OF = {"api", "private", "access", "signing", "encryption", "master", "service", "client", "account", "storage", "ssh"}
HARMLESS = {"public", "count", "length", "len", "max", "min", "limit", "type", "name", "file", "path", "url", "uri", "field", "label", "id"}
PLACEHOLDER = re.compile(
    r"(?i)^(?:changeme|change_me|example|placeholder|none|null|nil|true|false|undefined|your.*|x{3,}|\*+|\.+|-+|<.*>|\$\{.*|\$[A-Z_]+|%.*%|\{\{.*)$"
)
LIMIT = 0.5

# Words before a credential in headers; private keys in their armour; words that sentences have and passphrases don't.
_SCHEME = re.compile(r"(?:bearer|basic|token|digest|apikey|negotiate)[ \t]+", re.IGNORECASE)
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PLAIN = frozenset(
    "a an and are at be been by can cannot do does enter for from has have if in incorrect invalid is it its may must my new not of on or please required "
    "reset should that the their there this to type use was when which will with wrong you your".split()
) | SENSITIVE.keys()
LEAST_PART = 12
PASSPHRASE_SCORE, PASSPHRASE_WORDS = 0.55, 4

_SIGN = re.compile(r":=|=>|[:=]")
_AFTER_SIGN = re.compile(r"[ \t]*" + _SCHEME.pattern, re.IGNORECASE)
_QUOTED = re.compile(r"""[ \t]*(?:[bruf]{0,2})(?:\"{3}((?s:.*?))\"{3}|'{3}((?s:.*?))'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)""")
_BARE = re.compile(r"""[ \t]*([^\s,;#"'`()\[\]{}<>]+)""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\\)[ \t]*\n?")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_FIRST = re.compile(r"[A-Za-z_$]")


def base_spans(text: str) -> list[Span]:
    """The spans of the plain patterns, kind by kind, leftmost and not overlapping within a kind."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def name_score(name: str) -> float:
    """How sensitive a name is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    joined = any(a in KEY_OF and b == "key" for a, b in zip(words, words[1:], strict=False))
    return 1.0 if joined else score


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: length, mixture and entropy; placeholders have 0.

    A literal of several words has the score of the one that looks like a secret most, without a scheme like ``Bearer``;
    a private key in its armour has 1, and a passphrase a score that only the most sensitive names lift to the limit.
    """
    value = value.strip()
    n = len(value)
    if n < LEAST_ASSIGNED or PLACEHOLDER.match(value):
        return 0.0
    if any(c.isspace() for c in value):
        return _score_of_words(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search(r"[^\w]", value))))
    return min(1.0, 0.25 + 0.1 * kinds + 0.12 * entropy)


def _coded(value: str) -> bool:
    """Whether a word has letters and digits, or capitals after small letters, as codes have and words of prose don't."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value) or re.search("[a-z].*[A-Z]", value))


def _score_of_words(value: str) -> float:
    if _ARMOUR.search(value):
        return 1.0
    scheme = _SCHEME.match(value)
    words = value[scheme.end() if scheme else 0 :].split()
    least = LEAST_ASSIGNED if scheme and len(words) == 1 else LEAST_PART
    score = max((literal_score(w) for w in words if len(w) >= least and _coded(w)), default=0.0)
    phrase = len(words) >= PASSPHRASE_WORDS and all(w.isalnum() and w.lower() not in _PLAIN for w in words)
    return max(score, PASSPHRASE_SCORE) if phrase else score


def _path(value: str) -> bool:
    """Whether a bare value that starts with a slash is a path: keys in base64 have capitals, small letters and digits."""
    return not all(re.search(kind, value) for kind in ("[a-z]", "[A-Z]", "[0-9]"))


def _name_before(text: str, end: int) -> str | None:
    """The whole name that stands before a sign, perhaps in quotes or as a subscript; signs and names don't overlap, so
    reading backwards costs no more than the text is long."""
    while end and text[end - 1] in " \t":
        end -= 1
    if text[max(end - 2, 0) : end] in ('"]', "']"):
        end -= 2
    elif end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
        start -= 1
    first = _FIRST.search(text, start, end)
    return text[first.start() : end] if first else None


def assignments(text: str) -> Iterator[tuple[str, str | None, int, int, str | None]]:
    """The name-value pairs of a text: ``(name, literal, start, end, reference)``; a value is a literal or a reference."""
    for sign in _SIGN.finditer(text):
        name = _name_before(text, sign.start())
        if not name or text[sign.end() : sign.end() + 1] in ("=", ":", ">") or (sign[0] == ":" and text.startswith("//", sign.end())):
            continue
        quoted = _QUOTED.match(text, sign.end())
        if quoted:
            value, start, end = quoted[quoted.lastindex], quoted.start(quoted.lastindex), quoted.end(quoted.lastindex)
            after = quoted.end()
            while (plus := _PLUS.match(text, after)) and (more := _QUOTED.match(text, plus.end())):
                value += more[more.lastindex]
                end, after = more.end(more.lastindex), more.end()
            yield name, value, start, end, None
        elif (scheme := _AFTER_SIGN.match(text, sign.end())) and (bare := _BARE.match(text, scheme.end())):
            if _coded(bare[1]):
                yield name, bare[1], *bare.span(1), None
        elif bare := _BARE.match(text, sign.end()):
            if bare[1].startswith("/") and bare.start(1) == sign.end() and _path(bare[1]):
                continue
            called = text[bare.end() : bare.end() + 1] == "("
            if _IDENTIFIER.match(bare[1]):
                yield name, None if called else bare[1], *bare.span(1), None if called else bare[1]
            else:
                yield name, bare[1], *bare.span(1), None


def literal_spans(text: str, limit: float = LIMIT) -> list[Span]:
    """Spans of literals that reach a sensitive name, scored above ``limit``."""
    if ":" not in text and "=" not in text:
        return []
    pairs = list(assignments(text))
    defined: dict[str, list[tuple[str, int, int]]] = {}
    refers: dict[str, set[str]] = {}
    for name, literal, start, end, reference in pairs:
        if reference is None and literal is not None:
            defined.setdefault(name, []).append((literal, start, end))
        elif reference is not None:
            refers.setdefault(name, set()).add(reference)
    found: set[tuple[int, int]] = set()
    for name, literal, start, end, reference in pairs:
        sensitive = name_score(name)
        if not sensitive:
            continue
        reached = [(literal, start, end)] if reference is None and literal is not None else []
        todo, seen = ([reference] if reference else []), {name}
        known = False
        while todo:  # constants, through any chain of names
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            known |= at in defined
            reached += defined.get(at, ())
            todo += refers.get(at, ())
        if reference and not known:  # not the name of anything here: a bare literal
            reached.append((reference, start, end))
        found.update((s, e) for value, s, e in reached if sensitive * literal_score(value) >= limit)
    return [("literal", s, e) for s, e in sorted(found)]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the lexer adds literals that don't lie in a base span. Both by start, then kind."""
    base = base_spans(text)
    order = lambda spans: sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    added = [s for s in literal_spans(text) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return order(base), order(base + added)


def described(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text (null: empty), one row per row.

    Returns ``(doc_id, n_assign, n_access, n_hex, n_literal, base, spans)``, the last two as ``kind:start:end`` in code
    points, comma-joined. ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, base_of, spans_of = [], [], []
            for raw in texts(batch):
                base, spans = all_spans((raw or b"").decode())
                kinds = Counter(s[0] for s in spans)
                counts.append([kinds[k] for k in KINDS])
                base_of.append(described(base))
                spans_of.append(described(spans))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(base_of, pa.string()), pa.array(spans_of, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([docs.schema["doc_id"], *fields, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return shipped(docs.select("doc_id", "text")).mapInArrow(tidied(scan), schema)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones together) replaced."""
    parts, done = [], 0
    for _, start, end in all_spans(text)[1]:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with secrets replaced in ``text``; other columns and texts without secrets stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            new = [t if t is None else redacted(t.decode(), mark) for t in texts(batch)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return shipped(docs).mapInArrow(tidied(clean), docs.schema)
