import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import near_duplicates as nd
from labelmill.llm.common import sieve
from labelmill.llm.components import components, in_blocks
from tests.llm.helpers import empty, grouped, messy, near_groups, prose, shingles


def test_sets_match_tuples_of_words():
    texts = ["", " ", "a b", "A b", "a b c d e f a b c d e", prose(300, 4), "x\x0by\x0cz", "é É", "a\u00a0b c"]
    sets = nd.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[2] == sets[3]).all()


def test_words_do_not_depend_on_chunks(monkeypatch):
    from labelmill.llm import words

    text = (prose(500, 3) + " " + "long" * 300).encode()
    whole = words.word_hashes(text)
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    for a, b in zip(whole, words.word_hashes(text), strict=True):
        assert (a == b).all()


def test_super_minhash_is_the_least_rank_of_each_place():
    """Against the definition: each element's full permutation, all steps."""
    places = 16
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 3, 40)]
    got = nd.super_minhash(sets, places)
    for s, signature in zip(sets, got, strict=True):
        want = np.full(places, np.inf)
        for e in s:
            order = list(range(places))
            for step in range(places):
                one = np.array([e], np.uint64)
                draw = nd.mixed(one + nd.BASE * np.array([2 * step + 1], np.uint64))
                k = step + int(nd.mixed(draw + nd.BASE)[0] % np.uint64(places - step))
                order[step], order[k] = order[k], order[step]
                want[order[step]] = min(want[order[step]], step + float(draw[0] >> np.uint64(11)) * 2.0**-53)
        assert np.allclose(signature, want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
    a, b = np.sort(pool[:800]), np.sort(pool[100:900])
    x, y = nd.super_minhash([a, b], 400)
    assert abs((x == y).mean() - 700 / 900) < 0.06


def _near(n):
    """Chains, stars and copies of several texts, some just above and some just below the limit."""
    rows = []
    for g in range(n):
        base = prose(120, g).split()
        for k in range(6):
            words = list(base)
            for j in range(k):
                words[(j * 23 + 5) % 120] = f"new{g}{j}"
            rows.append((g * 10 + k, " ".join(words)))
        rows.append((g * 10 + 8, " ".join(base)))
    return rows


def test_groups_equal_brute_force(spark):
    rows = _near(12) + [(1000 + i, "shared boilerplate passage of some words " * 3 + prose(20, i)) for i in range(20)]
    got = {r["doc_id"]: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    want = near_groups(rows)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) and r["n_shingles"] == len(shingles(dict(rows)[d])) for d, r in got.items())


def test_pairs_meet_although_low_bytes_of_an_earlier_band_agree_by_chance(spark):
    low, fine = bytes(nd.PLACES), bytes(nd.FINE_PLACES)
    keys = {node: [1000 * node + band for band in range(nd.BANDS)] for node in (1, 2)}
    for band, key in ((3, 7), (5, 8)):
        keys[1][band] = keys[2][band] = key
    rows = [(key, band, node, node, 100, low, fine, keys[node]) for node in (1, 2) for band, key in ((3, 7), (5, 8))]
    members = spark.createDataFrame(rows, "key bigint, band int, node bigint, part bigint, n bigint, low binary, fine binary, bands array<bigint>")
    assert [tuple(r) for r in nd._across(members).collect()] == [(1, 2)]


def test_messy_rows(spark):
    df = messy(spark)
    rows = nd.near_duplicates(df).collect()
    want = near_groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert nd.near_duplicates(empty(spark)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    df = messy(spark)
    left = nd.deduplicate(df)
    assert left.columns == df.columns
    want = near_groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(7, 3), (3, 9), (1, 9), (20, 21), (21, 22)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == grouped({n for link in links for n in link}, links)


def test_blocks_bring_all_pairs_together(spark):
    rows = spark.createDataFrame([(g, i) for g in range(2) for i in range(9 * (g + 1))], "g int, id bigint")
    met = in_blocks(rows, "g", "id", block_rows=4)
    cells = {}
    for r in met.collect():
        cells.setdefault((r["g"], r["i"], r["j"]), set()).add(r["id"])
    for g in range(2):
        for a in range(9 * (g + 1)):
            for b in range(a):
                assert any(key[0] == g and {a, b} <= ids for key, ids in cells.items())


def test_sieve_passes_all_keys_and_few_others(spark):
    keys = spark.range(0, 4000, 4).select("id")
    passes = sieve(keys)
    got = {r["id"] for r in spark.range(4000).filter(passes(F.col("id"))).collect()}
    assert set(range(0, 4000, 4)) <= got and len(got) < 1300
    assert spark.range(9).filter(sieve(keys.limit(0))(F.col("id"))).count() == 0


def test_texts_that_meet_no_other_are_not_shuffled(spark, monkeypatch):
    rows = _near(1) + [(1000 + i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(300)]
    seen, full_sets = [], nd._full_sets
    monkeypatch.setattr(nd, "_full_sets", lambda docs, nodes: seen.append(docs.count()) or full_sets(docs, nodes))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert seen[0] < 30
    assert {r["doc_id"]: r["component_id"] for r in got} == near_groups(rows)
