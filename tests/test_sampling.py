import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelmill.operators import sampling as sm
from labelmill.operators.synthesis import class_index, synthesise_multilabel


def order(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


@pytest.fixture
def skewed(labelled):
    """One class holds most rows, as hot keys do."""
    rng = random.Random(1)
    pairs = [(f"text {i}", rng.choices("abcd", [90, 6, 3, 1])[0]) for i in range(3000)]
    return labelled(pairs, 7), pairs


def test_first_by_hash_takes_exact_quota(skewed, spark):
    df, pairs = skewed
    quota = {"a": 1234, "b": 1, "c": 10_000, "d": 0}
    table = spark.createDataFrame(list(quota.items()), "grp string, rank bigint")
    got = {r["row_id"] for r in sm.first_by_hash(df, F.col("label"), table).collect()}
    want = set()
    for l, n in quota.items():
        ids = sorted((i for i, (_, x) in enumerate(pairs) if x == l), key=order)
        want |= set(ids[:n])
    assert got == want


@pytest.mark.parametrize("digits, rank_rows", [(1, 10**6), (1, 20), (3, 10**6)])
def test_rank_thresholds_do_not_depend_on_buckets(skewed, spark, monkeypatch, digits, rank_rows):
    monkeypatch.setattr(sm, "RANK_ROWS", rank_rows)  # a small value divides the buckets again
    df, pairs = skewed
    ids = sorted((i for i, (_, x) in enumerate(pairs) if x == "a"), key=order)
    ranks = [1, 2, 777, len(ids), len(ids) + 1]
    targets = spark.createDataFrame([("a", k, r) for k, r in enumerate(ranks)], "grp string, k int, rank bigint")
    cuts = sm.rank_thresholds(df.select(F.col("label").alias("grp"), "row_id"), targets, digits=digits).collect()
    assert {r["k"]: r["cut_id"] for r in cuts} == {k: ids[r - 1] for k, r in enumerate(ranks) if r <= len(ids)}


@pytest.mark.parametrize("n", [1, 7, 500])
def test_sample_is_the_first_by_hash(skewed, n):
    df, pairs = skewed
    want = set(sorted(range(len(pairs)), key=order)[:n])
    assert {r["row_id"] for r in sm.sample_n(df, n).collect()} == want
    assert sm.sample_n(df, 10**9).count() == len(pairs)


def test_split_and_folds(skewed):
    df, pairs = skewed
    for share in (0.2, 0.25, 0.1):
        marked = sm.split_validation(df, share)
        assert marked.filter("is_validation").count() == math.ceil(share * len(pairs))
    folds = defaultdict(Counter)
    for r in sm.stratified_folds(df, 5).collect():
        folds[r["label"]][r["fold"]] += 1
    for label, count in folds.items():
        sizes = [count[f] for f in range(5)]
        assert sum(sizes) == sum(x == label for _, x in pairs) and max(sizes) - min(sizes) <= 1


def test_small_class_folds(labelled):
    rows = sm.stratified_folds(labelled([("t", "a"), ("u", "a"), ("v", "b")]), 5).collect()
    assert len(rows) == 3 and all(0 <= r["fold"] < 5 for r in rows)


def test_balance(labelled):
    pairs = [("t", "0")] * 70 + [("t", "1")] * 30
    count = lambda df: Counter(r["label"] for r in df.collect())
    assert count(sm.balance(labelled(pairs))) == {"0": 30, "1": 30}
    assert count(sm.balance(labelled(pairs), 20)) == {"0": 10, "1": 10}
    assert count(sm.balance(labelled(pairs + [("t", "2")]))) == {"0": 70, "1": 30, "2": 1}
    assert count(sm.balance(labelled([("t", "0")] * 5))) == {"0": 5}


def test_profile_sample(labelled):
    many = labelled([(f"t{i}", "xyz"[i % 3]) for i in range(30)])
    got = [(r["label"], r["row_id"]) for r in sm.profile_sample(many, "label").orderBy("row_id").collect()]
    assert got == [("x", 0), ("y", 1), ("x", 3), ("y", 4), ("x", 6), ("y", 7), ("z", 2), ("z", 5)] or sorted(got) == sorted(
        [("x", 0), ("x", 3), ("x", 6), ("y", 1), ("y", 4), ("y", 7), ("z", 2), ("z", 5)]
    )
    one = labelled([(f"t{i}", "x") for i in range(30)])
    assert sorted(r["row_id"] for r in sm.profile_sample(one, "label").collect()) == list(range(8))


def test_class_index_is_dense(skewed):
    df, pairs = skewed
    index, sizes = class_index(df)
    size = {r["label"]: r["size"] for r in sizes.collect()}
    assert size == Counter(x for _, x in pairs)
    seen = defaultdict(dict)
    for r in index.collect():
        seen[r["label"]][r["idx"]] = r["src_id"]
    for label, by_idx in seen.items():
        assert list(map(by_idx.get, range(size[label]))) == sorted((i for i, (_, x) in enumerate(pairs) if x == label), key=order)


def test_synthesis_counts_and_content(labelled):
    pairs = [(f' "{l}{i} {"w" * 150}" ', l) for i in range(20) for l in "abc"]
    df = labelled(pairs)
    rows = synthesise_multilabel(df).collect()
    assert Counter(r["kind"] for r in rows) == {1: 30, 2: 18, 3: 12}
    texts = {t.strip().strip('"'): l for t, l in pairs}
    for r in rows:
        labels = r["label"].split(",")
        assert len(labels) == r["kind"] == len(set(labels))
        if r["kind"] < 3:
            words = r["text"].split(" ")
            halves = [" ".join(words[i : i + 2]) for i in range(0, len(words), 2)]
            assert [texts[h] for h in halves] == labels
        else:
            assert len(r["text"]) == 403 and r["text"].endswith("...")
    again = synthesise_multilabel(df.repartition(11)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_synthesis_skips_parts_without_enough_classes(labelled):
    two = synthesise_multilabel(labelled([(f"t{i}", "ab"[i % 2]) for i in range(10)]))
    assert Counter(r["kind"] for r in two.collect()) == {1: 5, 2: 3}
    one = synthesise_multilabel(labelled([(f"t{i}", "a") for i in range(10)]))
    assert Counter(r["kind"] for r in one.collect()) == {1: 5}
    # A configured class without texts makes its draws drop out.
    three = synthesise_multilabel(labelled([(f"t{i}", "ab"[i % 2]) for i in range(100)]), labels=["a", "b", "zz"])
    kinds = Counter(r["kind"] for r in three.collect())
    assert kinds[1] == 50 and 0 < kinds[2] < 30 and kinds[3] == 0
