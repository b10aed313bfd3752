"""What a task's Python worker and its executor hold at once follows a limit in bytes, not the rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import crf, secrets
from labelmill.llm.common import shipped
from tests.llm.helpers import messy, prose

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    """Sets the session's limit; None: none of its own."""
    before = spark.conf.get(SETTING, None)
    put = lambda n: spark.conf.unset(SETTING) if n is None else spark.conf.set(SETTING, str(n))
    yield put
    put(before)


def _sizes(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["bytes", "rows"])

    return shipped(df).mapInArrow(sizes, "bytes bigint, rows bigint").collect()


def test_batches_of_long_texts_have_few_rows(spark, limit):
    limit(None)
    got = _sizes(spark.range(600, numPartitions=1).selectExpr("id AS doc_id", "repeat('a b ', 15000) AS text"))
    assert sum(r["rows"] for r in got) == 600 and max(r["bytes"] for r in got) <= 8 << 20


def test_a_sessions_own_limit_stays(spark, limit):
    limit(1 << 20)
    got = _sizes(spark.range(100, numPartitions=1).selectExpr("id AS doc_id", "repeat('a b ', 15000) AS text"))
    assert sum(r["rows"] for r in got) == 100 and max(r["bytes"] for r in got) <= 2 << 20


def test_secrets_with_texts_beyond_the_limit(spark, limit):
    limit(1000)
    df = messy(spark).unionByName(messy(spark).limit(1).selectExpr("77L AS doc_id", f"concat(repeat('a b ', 5000), 'password = {'x9' * 9}') AS text", "lang", "source", "n_chars", "component_id", "score", "row", "word", "key", "node"))
    rows = df.collect()
    plain = lambda found: sorted(map(repr, found))
    assert plain((r["doc_id"], r["text"]) for r in secrets.redact_secrets(df).collect()) == plain((r["doc_id"], r["text"] and secrets.redacted(r["text"])) for r in rows)
    assert plain((r["doc_id"], r["spans"]) for r in secrets.scan_secrets(df).collect()) == plain(
        (r["doc_id"], secrets.described(secrets.all_spans(r["text"] or "")[1])) for r in rows
    )


def test_words_of_many_sequences_are_labelled_in_bounded_memory():
    rng, labels = np.random.default_rng(1), 20
    model = crf.LanguageModel(
        [str(k) for k in range(labels)], rng.normal(size=(crf.BUCKETS + 1, labels)).astype(np.float32), np.empty(0, np.uint64), np.empty(0, np.int64),
        np.zeros((1, labels)), rng.normal(size=labels), rng.normal(size=(labels, labels)),
    )
    words = crf.Words([prose(n, n).encode() for n in (70, 0, 100_000, 1, 64, 50_000)])
    tracemalloc.start()
    got = crf._marginals(model, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    sequence, step = words.layout()
    score = np.zeros((int(sequence.max()) + 1, crf.STEPS, labels))
    score[sequence, step] = model.emissions(words)[words.at]
    filled = np.zeros(score.shape[:2], bool)
    filled[sequence, step] = True
    assert np.allclose(got, crf.forward_backward(score, filled, model.start, model.transition)[0][sequence, step], atol=1e-9)
