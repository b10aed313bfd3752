import math
from collections import Counter, defaultdict

import pytest

from labelmill.operators import features as ft
from labelmill.sources.writers import load_features, save_features

TEXTS = ["the cat sat on the mat", "The dog; the log!", "a b c", "cat's dog_1 über über", "zebra cat dog the", "it's it's fine"]


@pytest.fixture
def docs(labelled):
    return labelled([(t, "x") for t in TEXTS])


def tokens(t):
    import re

    return re.findall(r"\b\w\w+\b", t.lower())


def brute_tfidf(n_max):
    counts = [Counter(tokens(t)) for t in TEXTS]
    cf, df = Counter(), Counter()
    for c in counts:
        cf.update(c)
        df.update(c.keys())
    top = sorted(sorted(cf, key=lambda w: (-cf[w], w))[:n_max])
    idf = {w: math.log((1 + len(TEXTS)) / (1 + df[w])) + 1 for w in top}
    rows = []
    for c in counts:
        w = {top.index(t): n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows.append({i: v / norm for i, v in w.items()})
    return top, idf, cf, df, rows


@pytest.mark.parametrize("n_max", [4, 100])
def test_tfidf(docs, n_max):
    top, idf, cf, df, rows = brute_tfidf(n_max)
    vocab = ft.tfidf_fit(docs, n_max)
    assert [(r["term"], r["idx"], r["cf"], r["df"]) for r in vocab.orderBy("idx").collect()] == [
        (w, i, cf[w], df[w]) for i, w in enumerate(top)
    ]
    assert {r["term"]: pytest.approx(r["idf"]) for r in vocab.collect()} == idf
    got = defaultdict(dict)
    vectors = ft.tfidf_transform(docs, vocab)
    for r in ft.vector_cells(vectors).collect():
        got[r["row_id"]][r["idx"]] = pytest.approx(r["w"])
    assert {i: got[i] for i in range(len(TEXTS))} == dict(enumerate(rows))
    n = len(TEXTS)
    for r in ft.feature_stats(vectors, vocab).collect():
        column = [row.get(r["idx"], 0.0) for row in rows]
        mean = sum(column) / n
        assert r["mean"] == pytest.approx(mean)
        assert r["scale"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in column) / n) + 1e-8, abs=1e-7)


def test_vocabulary_size_is_checked(docs):
    with pytest.raises(ValueError):
        ft.tfidf_fit(docs, 0)


def sequence_words(t):
    from labelmill.functions.text import SEQUENCE_FILTERS

    return [w for w in t.lower().translate(str.maketrans(dict.fromkeys(SEQUENCE_FILTERS, " "))).split(" ") if w]


@pytest.mark.parametrize("num_words", [5, 100])
def test_sequences(docs, num_words):
    counts = Counter(w for t in TEXTS for w in sequence_words(t))  # insertion order is first appearance
    ranked = sorted(counts, key=lambda w: -counts[w])
    ids = {w: i + 2 for i, w in enumerate(ranked) if i + 2 < num_words}
    vocab = ft.sequence_fit(docs, num_words)
    assert {r["term"]: r["id"] for r in vocab.collect()} == ids
    want = {i: [ids.get(w, 1) for w in sequence_words(t)] for i, t in enumerate(TEXTS)}
    assert {r["row_id"]: r["sequence"] for r in ft.to_sequences(docs, vocab).collect()} == want
    for length in (3, 30):
        padded = {i: (s[-length:] + [0] * length)[:length] for i, s in want.items()}
        assert {r["row_id"]: r["sequence"] for r in ft.padded_sequences(docs, vocab, length).collect()} == padded


def test_sequences_of_empty_text(spark, labelled):
    df = labelled([("", "x"), ("cat", "x"), (None, "x")])
    got = {r["row_id"]: r["sequence"] for r in ft.padded_sequences(df, ft.sequence_fit(df), 2).collect()}
    assert got == {0: [0, 0], 1: [2, 0], 2: [0, 0]}


def test_lookup_does_not_shuffle(docs):
    before = docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    plan = ft.to_sequences(docs, ft.sequence_fit(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == before


def test_transform_does_not_shuffle(docs):
    vocab = ft.tfidf_fit(docs)
    before = docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    cells = ft.vector_cells(ft.tfidf_transform(docs, vocab))
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange") == before


def test_save_and_load(spark, docs, tmp_path):
    vocab = ft.tfidf_fit(docs)
    stats = ft.feature_stats(ft.tfidf_transform(docs, vocab), vocab)
    save_features(str(tmp_path / "f"), vocab, stats, docs.select("label").distinct())
    again, size = load_features(spark, str(tmp_path / "f"))
    assert size == vocab.count() and sorted(map(tuple, again.collect())) == sorted(map(tuple, vocab.collect()))
    assert spark.read.parquet(str(tmp_path / "f" / "stats")).count() == size
