import random
import zlib

import numpy as np
import pytest

from labelmill.llm import packing, tokens
from labelmill.llm.packing import Capacity, best_fit
from tests.llm.helpers import empty, messy

FILE = "byte_bpe_50k.json"
PARTS = ["foo", "bar's", " ", "  ", "\n", "\n ", "\t", "<|endoftext|>", "<|endo", "日本", "ä", "  x", "123", "!!", "\x85", "\xa0", "a" * 50, "'ll", " '", "\x1c", "e\u0301"]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(FILE)


def _texts(n, longest=60):
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_units_give_the_library_s_ids(tokenizer):
    units, batch = tokens.Units(tokenizer), _texts(600)
    for text, values in zip(batch, units.encode(batch), strict=True):
        assert np.frombuffer(b"".join(values), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (40, 36), (200, 34)])
def test_spliced_chunks_give_the_library_s_ids(tokenizer, chunk, overlap):
    for text in [*_texts(300), "a" * 5000, " " * 700 + "b", "<|endoftext|>" * 40]:
        got = [i for ids in tokens.spliced_ids(tokenizer, text, chunk, overlap) for i in ids]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_counts_of_messy_rows(spark, tokenizer):
    df = messy(spark)
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
    for huge in (tokens.HUGE_CHARS, 10):
        rows = tokens.token_counts(df, FILE, limit=100, huge=huge).collect()
        assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert tokens.token_counts(empty(spark), FILE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(100, 100), Capacity(100, 3), Capacity(100, 5, 4000)])
def test_best_fit_respects_every_constraint(rule, capacity):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, capacity.longest, 700)
    sequence, offset = best_fit(lengths, capacity, rule)
    for s in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == s)
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.concatenate(([0], np.cumsum(lengths[order])[:-1]))).all()
        assert lengths[mine].sum() <= capacity.tokens and len(mine) <= capacity.documents
        assert (lengths[mine].astype(float) ** 2).sum() <= capacity.vector[2] + 1e-6
    least = max(lengths.sum() / capacity.tokens, len(lengths) / capacity.documents, (lengths.astype(float) ** 2).sum() / capacity.vector[2])
    assert sequence.max() + 1 <= 1.3 * least + 1


def test_best_fit_fills_sequences():
    lengths = np.minimum(2047, np.random.default_rng(2).lognormal(6, 1, 3000).astype(int) + 1)
    sequence, _ = best_fit(lengths, Capacity())
    assert sequence.max() + 1 <= lengths.sum() / 2048 + 2


def test_best_fit_of_nothing():
    assert len(best_fit(np.empty(0, int), Capacity())[0]) == 0


def test_packing_round_trip(spark, tokenizer):
    df = messy(spark)
    capacity = Capacity(64, 10)
    rows = packing.pack_documents(df, FILE, capacity).collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r["doc_id"], []).append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        whole = ids[r["doc_id"]][0]
        assert zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 64
        by_doc.setdefault(r["doc_id"], []).append(r["length"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(x) for d, x in by_doc.items()} == {d: sum(map(len, x)) for d, x in ids.items()}
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64 and len(parts) <= 10
    made = packing.sequences(df, FILE, capacity).collect()
    assert sorted(i for r in made for i in r["input_ids"]) == sorted(i for x in ids.values() for one in x for i in one)
    assert all(len(r["input_ids"]) == sum(r["lengths"]) <= 64 for r in made)
    assert packing.pack_documents(empty(spark), FILE).count() == 0
