import hashlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelmill.llm import fingerprints as fp
from labelmill.llm import mixing, queries, url_reputation
from tests.llm.helpers import empty, messy, prose, words

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/de/",
    "http://x.com/fr", "http://com/fr/", "http://notexample.org/es/", "ftp://h.co.uk", "http://a.b.c.co.uk/p", "x://y://z/", "http://É.net/a\nb", "http://bad.net/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "?", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, mean int")
    outcomes = spark.createDataFrame([("bad.net", True)] * 30 + [("good.net", False)] * 300 + [(None, True), ("x", None)], "host string, bad boolean")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, outcomes, queries.URL_RULES).collect()}
    assert len(got) == len(URLS)
    rule = {4: "example.org/es/", 5: "example.org/en/1", 6: "org/", 7: "com/de/", 9: "com/fr/", 10: "org/"}
    assert {i: r["rule"] for i, r in got.items() if r["rule"]} == rule
    said = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert all(got[i]["verdict"] == said[text] for i, text in rule.items())
    assert (got[4]["host"], got[4]["path"]) == ("a.example.org", "/es/x") and (got[0]["host"], got[1]["path"]) == ("", "")
    assert (got[13]["host"], got[13]["path"]) == ("y:", "//z/") and (got[14]["host"], got[14]["path"]) == ("É.net", "/a\nb")
    assert got[15]["verdict"] == "block" and got[12]["verdict"] == "allow"


def test_reputation_shrinks_towards_the_domain(spark):
    outcomes = [("a.spam.net", True)] * 50 + [("b.spam.net", True)] * 40 + [("c.spam.net", False)] + [("a.fine.net", False)] * 80 + [("d.org", True)] + [("e.org", False)] * 9
    hosts = ["a.spam.net", "c.spam.net", "new.spam.net", "new.fine.net", "unknown.org", "else.xyz"]
    got = {
        r["host"]: r for r in url_reputation.reputation(
            spark.createDataFrame(outcomes, "host string, bad boolean"), spark.createDataFrame([(h,) for h in hosts], "host string")
        ).collect()
    }
    assert got["a.spam.net"]["mean"] > got["new.spam.net"]["mean"] > got["c.spam.net"]["mean"] > got["new.fine.net"]["mean"]
    assert all(0 <= r["mean"] <= 1 and r["bound"] < r["mean"] for r in got.values())
    nothing = url_reputation.reputation(spark.createDataFrame([], "host string, bad boolean"), spark.createDataFrame([("h",)], "host string")).first()
    assert nothing["mean"] == 0.5 and nothing["n_labelled"] == 0


def test_tables_without_rows(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_reputation.judge_urls(pages, spark.createDataFrame([], "host string, bad boolean"), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_mix_of_messy_rows(spark):
    df = messy(spark)
    for bucket_rows in (mixing.BUCKET_ROWS, 2):
        rows = mixing.mix(df, bucket_rows=bucket_rows).collect()
        assert sorted(r["size"] for r in rows) == sorted(len(words(r["text"])) for r in df.collect())
        total = sum(r["size"] for r in rows)
        sources = {r["source"]: (r["source_size"], r["target"]) for r in rows}
        assert abs(sum(t for _, t in sources.values()) - total) < 1e-6
        for source, (size, target) in sources.items():
            mine = [r for r in rows if r["source"] == source]
            assert sum(r["size"] for r in mine) == size and target <= 3 * size
            assert sum(r["taken"] for r in mine) == round(target)
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix(df.repartition(7), bucket_rows=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(empty(spark)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame([("a", 10, 5), ("b", 1000, 2), ("c", 100, 1), ("d", 0, 5)], "source string, source_size bigint, weight int")
    got = {r["source"]: r["target"] for r in mixing.targets(sources, 1110).collect()}
    assert got["a"] == 30.0 and got["c"] == 300.0 and got["d"] == 0.0 and got["b"] == pytest.approx(780.0)


def test_numbers_follow_code_points(spark):
    names = ["b", "a", None, "aa", "\U0001f600", "\uffff", "Z", ""]
    got = mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string"), "source").collect()
    assert [r["source"] for r in sorted(got, key=lambda r: r["number"])] == [*sorted(n for n in names if n is not None), None]


def test_take_repeats_documents(spark):
    df = messy(spark)
    taken = mixing.take(df, mixing.mix(df))
    assert taken.columns == df.columns and taken.count() > 0


def _hashes(text):
    """Shingle hashes as the engine chains them: 64-bit xxHash, seeded with 42 and then with the hash so far."""
    w = [x.encode() for x in text.lower().strip(" \t\n\x0b\f\r").replace("\t", " ").split() if x]

    def chain(items):
        h = 42
        for item in items:
            h = xxhash.xxh64_intdigest(item, h)
        return h

    return {chain(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {chain(w)} if w else set()


def _bin(h):
    signed = h - (1 << 64) if h >> 63 else h
    return (signed >> (64 - fp.BIN_BITS)) + fp.BINS // 2, signed


def _expected(text):
    least = {}
    for h in _hashes(text):
        at, value = _bin(h)
        least[at] = min(value, least.get(at, value))
    if not least:
        return []
    out = []
    for b in range(fp.BINS):
        if b not in least:
            def order(at, b=b):
                h = xxhash.xxh64_intdigest(int(at).to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(int(b).to_bytes(4, "little"), 42))
                return h - (1 << 64) if h >> 63 else h
            value = least[min(least, key=order)]
        else:
            value = least[b]
        out.append((value & 255) - 128)
    return out


def test_fingerprints_equal_a_plain_version(spark):
    texts = [prose(n, n) for n in (1, 4, 5, 6, 30, 200, 900)] + ["", "  ", "A b", "a  B\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", fp.fingerprint(F.col("text")).alias("fp")).collect():
        assert list(r["fp"]) == _expected(r["text"]), r["text"][:30]


def test_likeness_is_unbiased(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        w = [str(x) for x in rng.choice(10**6, 300, replace=False)]
        rows.append((" ".join(w), " ".join([*w[: 100 + 3 * i], *(str(x) for x in rng.choice(10**6, 60) + 10**6)])))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("near"))
    errors = []
    for r in df.collect():
        a, b = _hashes(r["a"]), _hashes(r["b"])
        errors.append(r["near"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


@pytest.mark.parametrize("partitions", [1, 3])
def test_edits_of_messy_rows(spark, partitions):
    df = messy(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = fp.fingerprint_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect()), key=lambda r: r[0])
    want = []
    for i, (d, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(i + 1) % len(docs)][1][:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0 and by[3]["fingerprint"] == ""
    assert fp.fingerprint_edits(empty(spark)).count() == 0
    one = fp.fingerprint_edits(df.filter("doc_id = 6")).first()
    assert 0 < one["near_edited"] <= 1 and one["near_next"] == 1.0

