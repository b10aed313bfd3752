import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from labelmill.llm import alignment, queries, tokens
from tests.llm.helpers import empty, messy

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PARTS = [
    "foo", "bar's", " ", "  ", "\n", "\n ", "\t", "<|endoftext|>", "</s>", "<0x41>", "日本", "ä", "é ", "  x", "123", "!!", "\x85", "\xa0", "a" * 50, "'ll", " '", "\x1c", "\x00",
    "é", "\r\n", "😀", " ", "ﬁ", " unlikely", "Ελλ", "퟿", " ", " ",
]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    import public_tokenizers as P

    a = Tokenizer.from_file(P.path(A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=P.path(B))


def byte_chars():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def plain(text, a, b, chars):
    """Ids with their byte ranges by both, from decoded bytes alone."""
    if not text:
        return [], []
    sides, raw = [], (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(chars[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    for ids, parts in ((a_ids, a_parts), (b_ids, b_parts)):
        if b"".join(parts) != raw:
            return [], []
        ends = np.cumsum([len(p) for p in parts]).tolist()
        sides.append([(i, e - len(p), e) for i, e, p in zip(ids, ends, parts)])
    return sides


def expected(rows):
    a, b = libraries()
    chars = byte_chars()
    out, held = [], Counter()
    for doc, text in rows:
        left, right = plain(text, a, b, chars)
        links = [(x, y) for x, s, e in left for y, u, v in right if s < v and u < e]
        held.update(set(links))
        common = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = ";".join(
            ",".join(str(x) for x, _, e in left if s < e <= t) + "|" + ",".join(str(y) for y, _, e in right if s < e <= t)
            for s, t in zip([0, *common], common)
        )
        out.append((doc, len(left), len(right), len(common), links, groups))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (doc, n_a, n_b, n, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), groups) for doc, n_a, n_b, n, links, groups in out
    ]


def _texts(n, longest=25, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return texts + ["", None, " ", "  ", "▁", "a▁ b", "a ▁b c", "\n", "x y", "x　y z", "wordwithoutspaces" * 300]


def found(df, frequent=alignment.FREQUENT):
    scored = alignment.score_links(alignment.align(df, A, B), A, B, frequent)
    return [tuple(r) for r in scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 0.003, 2.0])
def test_alignment_equals_brute_force(spark, frequent):
    rows = list(enumerate(_texts(400)))
    rows += rows[:5] + [(None, "a null id"), (1000, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got, want = found(df, frequent), expected(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in want) > 4 and sum(r[5] < r[4] for r in want) > 50


def test_small_tables_and_joined_units(spark, monkeypatch):
    rows = list(enumerate(_texts(200, seed=5)))
    monkeypatch.setattr(alignment, "TABLE_UNITS", 600)
    monkeypatch.setattr(alignment, "JOINED_UNITS", 7)
    monkeypatch.setattr(alignment, "JOINED_TEXTS", 3)
    both, kept = alignment.Aligner(A, B), 0
    for start in range(0, len(rows), 9):
        part = rows[start : start + 9]
        kept += both.held > 600 and 0 < (both.uses > 1).sum() <= len(both.uses) / 2
        sums, groups, pairs, times, bounds = both.align([(t or "").encode() for _, t in part])
        for i, want in enumerate(expected(part)):
            assert tuple(sums[:, i]) == want[1:5] and groups[i] == want[7]
            assert times[bounds[i] : bounds[i + 1]].sum() == want[4]
    assert kept


def test_spans_are_refined_by_bytes():
    # A character of three bytes in two tokens, then three bytes that stand for one character.
    assert alignment._byte_ends(np.array([0, 1, 1, 4]), np.array([4, 4, 4, 6]), np.array([2, 1, 1, 2])).tolist() == [2, 3, 4, 6]
    assert alignment._byte_ends(np.array([0, 1, 1, 1]), np.array([1, 1, 1, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]


def test_messy_rows(spark):
    df = messy(spark).filter("length(text) < 20000 or text is null")
    assert sorted(found(df), key=repr) == sorted(expected([(r["doc_id"], r["text"]) for r in df.collect()]), key=repr)
    assert found(empty(spark)) == []
    long = messy(spark).filter("length(text) >= 20000")
    assert [r[1] for r in found(long)] == [len(libraries()[0].encode(" " + r["text"], add_special_tokens=False).ids) for r in long.collect()]


def test_packed_pairs():
    pairs, times = np.array([3, 4, 1_600_000_000, 1 << 40]), np.array([1, 70000, 1, 2])
    back = alignment._unpacked(alignment._packed(pairs, times), 4)
    assert back[0].tolist() == pairs.tolist() and back[1].tolist() == times.tolist()
    assert alignment._unpacked(alignment._packed(pairs[:0], times[:0]), 0)[0].tolist() == []


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect()}
    a, b = libraries()
    assert len(got) == len(docs) and tokens.load(A).encode_special_tokens is False
    short = [(d, t) for d, t in docs if len(t or "") < 3000][:60]
    for d, n_a, n_b, n_groups, n_links, _, _, groups in expected(short):
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, n_links)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        assert 0 <= r["n_best"] <= n_links <= r["count_sum"] or not n_a
