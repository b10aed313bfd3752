import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import brown, crf
from labelmill.llm.words import word_hashes
from tests.llm.helpers import empty, messy, prose, words


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    labels, steps = 3, 4
    score, start, move = rng.normal(size=(2, steps, labels)), rng.normal(size=labels), rng.normal(size=(labels, labels))
    filled = np.array([[True] * 4, [True, True, False, False]])
    marginal, moves, total = crf.forward_backward(score, filled, start, move)
    want_moves, want_total = np.zeros((labels, labels)), 0.0
    for s, n in ((0, 4), (1, 2)):
        weights = {}
        for path in itertools.product(range(labels), repeat=n):
            value = start[path[0]] + sum(score[s, t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))
            weights[path] = math.exp(value)
        z = sum(weights.values())
        want_total += math.log(z)
        for t in range(n):
            want = [sum(w for p, w in weights.items() if p[t] == k) / z for k in range(labels)]
            assert np.allclose(marginal[s, t], want)
        for path, w in weights.items():
            for a, b in itertools.pairwise(path):
                want_moves[a, b] += w / z
    assert np.allclose(moves, want_moves)
    assert math.isclose(total, want_total, rel_tol=1e-9)


def test_words_of_code_switched_text(spark):
    en = ["the house and the water of this thing", "there was nothing with the other thought"]
    de = ["der schöne zug und die straße nach schloss", "ich möchte zwischen den häusern schlafen"]
    rows = [(i, t + f" {x}", lang) for i, (t, lang, x) in enumerate([(t, k, x) for t, k in [(t, "en") for t in en] + [(t, "de") for t in de] for x in "abcdefgh"])]
    model = crf.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"]
    switched = spark.createDataFrame([(1, "the water and the house, schöne straße und häusern"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["words"] for r in crf.label_words(switched, model).collect()}
    assert [w["lang"] for w in got[1]] == ["en"] * 5 + ["de"] * 4
    assert [w["word"] for w in got[1]][:2] == ["the", "water"] and got[2] == []


def test_language_of_messy_rows(spark):
    df = messy(spark)
    rows = crf.identify_held_out(df).collect()
    assert len(rows) == df.count()
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        lettered = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] in ("en", "fr")) == lettered and (r["lang_pred"] == "und") != lettered
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] or "").encode()) % 4 == 2)
    assert crf.identify_held_out(empty(spark)).count() == 0
    nobody = crf.identify_held_out(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = crf.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_rejected_documents(spark):
    df = messy(spark)
    left = crf.keep_identified(df)
    assert left.columns == df.columns
    # Texts without letters go, and the two that no other document vouches for.
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 6, 7, 8, 10]
    assert crf.keep_identified(empty(spark)).count() == 0


def test_junk_and_foreign_texts_go_in_any_number_of_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) > 200")
    of = {k: docs.filter(F.col("lang") == k).orderBy("doc_id").first()["text"][:400] for k in ("en", "fr", "de", "es")}
    junk = " ".join(f"{chr(97 + i * i % 26)}{chr(97 + i * 7 % 26)}qx{chr(97 + i * 11 % 26)}z{chr(97 + i % 26)}" for i in range(60))
    foreign = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    planted = {-1: junk, -2: foreign, -3: "Все люди рождаются свободными и равными в своем достоинстве и правах.", -4: " ".join(of.values()), -5: of["fr"] + " " + of["en"]}
    two = docs.filter(F.col("lang").isin("en", "fr"))
    for known in (docs, two):
        left = {r["doc_id"] for r in crf.keep_identified(known.unionByName(spark.createDataFrame([(k, t, None) for k, t in planted.items()], docs.schema))).collect()}
        assert {k for k in left if k < 0} == {-4, -5}
        assert left - {-4, -5} == {r["doc_id"] for r in known.collect()}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_labelled_junk_goes_at_every_size(spark, size):
    """A label of its own doesn't help a text, and a row goes alone, not with those that share its id."""
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) > 100")
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(120)) for _ in range(20)]
    foreign = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    first = docs.orderBy("doc_id").first()["doc_id"]
    rows = [(first if i == 0 else -i, t, ["en", "fr", "de", "es"][i % 4]) for i, t in enumerate([*junk, foreign])]
    left = crf.keep_identified(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()
    assert sorted(map(tuple, left)) == sorted(map(tuple, docs.collect()))


def test_exchange_raises_likelihood_and_finds_blocks():
    rng = np.random.default_rng(4)
    types, classes = 24, 3
    true = np.arange(types) % classes
    follow = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    counts = np.array([[rng.poisson(40 * follow[true[a], true[b]]) for b in range(types)] for a in range(types)])
    got = brown.exchange(counts, classes)
    assert all(len({g for g, t in zip(got, true, strict=True) if t == c}) == 1 for c in range(classes))
    assert len(set(got)) == classes


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text").collect(), {r["doc_id"]: r for r in brown.score_held_out(docs).collect()}


def test_base_scores_equal_brute_force(scored):
    rows, got = scored
    tokens = {r["doc_id"]: [*words(r["text"]), b""] for r in rows}
    learnt = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for d in learnt for w in tokens[d])
    n, v = sum(count.values()), len(count)
    assert set(got) == set(tokens)
    for d, t in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d not in set(learnt), len(t), sum(w in count for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)


def test_class_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored[1].values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark, sf_dir):
    """Summed over all training words and the unseen one of each type, probabilities are 1 after any class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    model = brown.train(docs)
    counts = brown.word_counts(docs).collect()
    mass = np.zeros(len(model.class_of))
    for r in counts:
        word = np.array([r["word"]], np.int64).view(np.uint64)
        type_, _, _ = model.types(word, np.array([r["suffix"]]))
        mass[type_[0]] += 10 ** model.emission[type_[0]] * (r["n"] + 1 if type_[0] >= model.own else 1)
    mass[model.own :] += 10 ** model.emission[model.own :]  # unseen words
    by_class = np.bincount(model.class_of, mass, minlength=len(model.transition))
    used = np.bincount(model.class_of, minlength=len(model.transition)) > 0
    assert np.allclose(by_class[used], 1.0)
    assert np.allclose((10**model.transition).sum(axis=1), 1.0)


def test_scores_of_messy_rows(spark):
    df = messy(spark)
    rows = brown.score_held_out(df).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(words(r["text"])) + 1 for r in df.collect())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert brown.score_held_out(empty(spark)).count() == 0
    assert all(r["perplexity"] > 1 for r in brown.perplexity(brown.score_held_out(df)).collect())


def test_every_training_word_has_a_class_of_its_own_choice(spark, sf_dir):
    """Words of one suffix get classes by their neighbours, in memory or joined, and rounds raise the likelihood."""
    rng = random.Random(3)
    groups = [[f"{c}{i}ing" for i in range(30)] for c in "abc"]
    lines = [" ".join(rng.choice((("at", "on", "up")[k % 3], rng.choice(groups[k % 3]))) for k in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    by_hash = {int(word_hashes(w.encode())[0].view(np.int64)[0]): w for g in groups for w in g}
    for share in (1e-9, 0.05):  # all words in memory, and only the frequent ones
        model = brown.train(docs, classes=8, own_share=0.05, table_share=share)
        found = {int(h): int(c) for h, c in zip(model.words.view(np.int64), model.class_of[: model.own], strict=True)}
        assert len(found) == (94 if share < 0.05 else 4)
        found |= {r["word"]: r["class"] for r in model.rare.collect()}
        assert len(found) == 94
        most = [Counter(found[h] for h, w in by_hash.items() if w[0] == c).most_common(1)[0] for c in "abc"]
        assert len({c for c, _ in most}) == 3 and min(n for _, n in most) > 20  # though all end alike
    text = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [
        sum(r["score"] for r in brown.score_held_out(text, rounds=rounds).collect() if not r["held_out"]) for rounds in (0, 2)
    ]
    assert held[1] > held[0]


def test_rare_words_are_scored_by_their_own_classes(spark):
    """Scores equal brute force from the model's tables when most words are joined and some are unseen."""
    lines = [prose(80, i) + f" odd{i % 7} rare{i} rare{i + 1}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    model = brown.train(docs.filter("doc_id < 20"), table_share=0.01)
    rare = {r["word"]: (r["n"], r["class"]) for r in model.rare.collect()}
    counts = {r["word"]: r["n"] for r in brown.word_counts(docs.filter("doc_id < 20")).collect()}
    assert len(rare) > 50 and all(counts[w] == n for w, (n, _) in rare.items())
    got = {r["doc_id"]: r["score"] for r in brown.score(docs, model).collect()}
    for d, line in enumerate(lines):
        token, suffix, _, _ = brown._tokens([line.encode()])
        type_, _, known = model.types(token, suffix)
        total, before = 0.0, int(model.class_of[np.searchsorted(model.words, brown.END)])
        for h, t, k in zip(token.view(np.int64).tolist(), type_, known, strict=True):
            n, class_ = (0, 0) if k else rare.get(h, (0, int(model.class_of[t])))
            total += model.emission[t] if k else math.log10(n + 1) - model.divisor[class_]
            class_ = int(model.class_of[t]) if k else class_
            total += model.transition[before, class_]
            before = class_
        assert math.isclose(got[d], total, rel_tol=1e-9)
