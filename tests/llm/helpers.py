"""Small tables with the awkward cases every operator must handle, and plain versions of some definitions."""

from __future__ import annotations

WORDS = "the and of to in is that it for was on are as with his they at be this from have or by one had not but what all were when".split()

MESSY = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, score string, row string, word int, key int, node int"


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * (seed + 3)) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


def messy(spark):
    """Nulls, an empty, a blank and a very long text, ties, repeated rows, and extra columns with an operator's own names."""
    rows = [
        (1, prose(40, 1), "en", "b"), (2, prose(40, 1), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "fr", "a"),
        (6, prose(30000, 2), "fr", "c"), (7, "one two", "en", None), (8, "One\tTWO", "en", "a"), (9, "…—", None, "a"), (9, "…—", None, "a"),
        (10, prose(40, 1) + " tail", "fr", "b"), (None, prose(40, 1), "en", "b"), (11, "é" * 50, "fr", "\U0001f600"), (12, "x" * 3000, "en", "z"),
    ]
    return spark.createDataFrame([(d, t, l, s, len(t or ""), "?", "?", "?", 1, 2, 3) for d, t, l, s in rows], MESSY).repartition(3)


def empty(spark):
    return spark.createDataFrame([], MESSY)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(nodes, links) -> dict:
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(pairs) -> dict:
    """Expected component by id for ``(id, text)`` pairs, from all pairs of full sets."""
    sets = [(d, shingles(t)) for d, t in pairs if d is not None]
    links = [
        (a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return grouped({d for d, _ in sets}, links)
