import hashlib
import random

import pytest

from labelmill.llm import bpe_codec, bpe_words, queries, tokens
from tests.llm.helpers import empty, messy

FILE = "byte_bpe_50k.json"
PARTS = [
    "foo", "bar's", " ", "  ", "\n", "\n ", "\t", "<|endoftext|>", "<|endo", "ftext|>", "日本", "ä", "é ", "  x", "123", "!!", "\x85", "\xa0", "a" * 50, "'ll", " '", "'s", "'", "\x1c", "\x00",
    "é", "\r\n", "A", "9", " ", "　", "×", "÷ ", "€ ", "²", "\x7f",
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(FILE)


def _texts(n, longest=40, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_words_are_encoded_independently(tokenizer):
    special = bpe_words.special_strings(tokenizer)
    batch = [*_texts(4000), "<|endo", "ftext|>", "!<|endo", "ftext|>x", "", "a"]
    found, bounds = bpe_words.words([t.encode() for t in batch], special)
    plain = found.to_pylist()
    ids = {w: tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in set(plain)}
    for i, text in enumerate(batch):
        mine = plain[bounds[i] : bounds[i + 1]]
        assert b"".join(mine) == text.encode()
        assert [x for w in mine for x in ids[w]] == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(set(plain)) < len(plain) / 2


def test_tables_of_words_give_the_library_s_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_words, "TABLE_WORDS", 1500)
    monkeypatch.setattr(bpe_words, "JOINED_WORDS", 9)
    table, shrunk, batch = bpe_words.WordTable(tokenizer), 0, _texts(2000, seed=9)
    for start in range(0, len(batch), 70):
        part = batch[start : start + 70]
        shrunk += table.held > 1500 and 0 < 2 * (table.uses > 1).sum() < len(table.uses)
        ids, bounds = table.encode([t.encode() for t in part])
        for i, text in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert shrunk
    assert [x.tolist() for x in table.encode([])] == [[], [0]] and [x.tolist() for x in table.encode([b"", b""])] == [[], [0, 0, 0]]


def test_other_kinds_of_tokenizers_are_errors():
    with pytest.raises(ValueError, match="byte-level"):
        bpe_words.special_strings(tokens.load("word_bpe_49k.json"))


def _library(tokenizer, df):
    want = []
    for r in df.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], ids, tokenizer.decode(ids, skip_special_tokens=False)))
    return sorted(want, key=repr)


@pytest.mark.parametrize("frequent, sample", [(bpe_codec.FREQUENT, bpe_codec.SAMPLE), (0.002, 1.0), (2.0, 0.5)])
def test_ids_and_texts_are_the_library_s(spark, tokenizer, frequent, sample, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(bpe_codec, "DECODED_IDS", 500)
    rows = [(i, t) for i, t in enumerate(_texts(300))]
    rows += [(1000 + i, "the same text, many times over") for i in range(100)] + [(5, rows[5][1])] * 3
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), messy(spark)):
        got = bpe_codec.decode(bpe_codec.encode(df, FILE, frequent, sample), FILE).collect()
        assert sorted([(r["doc_id"], r["ids"], r["text"]) for r in got], key=repr) == _library(tokenizer, df)


def test_frequent_words_are_bounded(spark, tokenizer):
    rows = [(i, f"common words {i} " + "x" * 400) for i in range(400)]
    table = bpe_codec.frequent_words(spark.createDataFrame(rows, "doc_id bigint, text string"), FILE, 0.1, 1.0)
    assert set(table["word"].to_pylist()) == {b"common", b" words"} and sum(len(w) + 8 for w in table["word"].to_pylist()) <= 16 / 0.1
    assert [tokenizer.decode(x) for x in table["ids"].to_pylist()] == [w.decode() for w in table["word"].to_pylist()]


def test_nothing_gives_nothing(spark):
    assert bpe_codec.encode(empty(spark), FILE).collect() == []
    nothing = spark.createDataFrame([("a", None), ("b", [])], "doc_id string, ids array<int>")
    assert {tuple(r) for r in bpe_codec.decode(nothing, FILE).select("doc_id", "text").collect()} == {("a", ""), ("b", "")}


def test_decoding_any_ids(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randint(0, 30))]) for i in range(300)]
    got = bpe_codec.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), FILE).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: tokenizer.decode(ids, skip_special_tokens=False) for i, ids in rows}
    odd = spark.createDataFrame([(1, [64, -1, 999999, None, 65])], "doc_id bigint, ids array<int>")
    assert bpe_codec.decode(odd, FILE).first()["text"] == tokenizer.decode([64, 65])


def test_query(spark, sf_dir, tokenizer):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_bpe_codec"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
