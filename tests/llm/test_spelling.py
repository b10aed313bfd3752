import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill.llm import queries, spelling
from tests.llm.helpers import empty, messy


def counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def expected(rows):
    n = counts(rows)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed, n=400):
    rng = random.Random(seed)
    letters = "abcdeéèÀ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaaaa", "abababab"]

    def word():
        w = list(rng.choice(stems[: rng.choice([2, 5, 15])]))
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
        return rng.choice([str.lower, str, str.capitalize])("".join(w))

    return [(i, rng.choice([" ", "-", "1"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("symbols", [None, 4, 6, 64])
def test_variants_equal_brute_force(spark, symbols):
    rows = variants(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = expected(rows)
    assert sum(f is not None for f, *_ in want.values()) > 100 and any(f is not None and r != f for f, r, *_ in want.values())
    assert found(spelling.group_variants(df, symbols)) == want


def test_messy_rows(spark):
    df = messy(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()] + [(1, None), (2, "")]
    more = spark.createDataFrame([(None, "Straße÷× ÀÉÎõüÿþ"), (None, "Straße÷× ÀÉÎõüÿþ"), (1, "Straße÷x")] * 2, "doc_id bigint, text string")
    rows += [(r["doc_id"], r["text"]) for r in more.collect()]
    assert found(spelling.group_variants(df.select("doc_id", "text").unionByName(more))) == expected(rows)
    assert spelling.group_variants(empty(spark)).collect() == []


def test_the_alphabet_follows_the_vocabulary(spark):
    few = spark.range(50).select(F.concat(F.lit("word"), F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")).alias("word"))
    many = spark.range(60000).select(F.concat(F.lit("word"), F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")).alias("word"))
    assert spelling.alphabet(few) < spelling.alphabet(many)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = found(queries.QUERIES["op12_spelling_variants"](spark, sf_dir))
    assert got == expected([(r["doc_id"], r["text"]) for r in docs])
