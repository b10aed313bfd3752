"""Requests that are asked once and appends that happen once, also when tasks die and jobs run again."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from labelmill.operators import requests as rs
from labelmill.operators.ledger import Ledger
from labelmill.plans import generate as gen
from labelmill.sources import batches as bt
from labelmill.sources import writers as wr


def plan(spark, n=40):
    return spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit("a").alias("class_label"), F.lit("t").alias("prompt_type"), F.concat(F.lit("p"), "id").alias("prompt"))


def calls(folder):
    return sorted(int(n.split("-")[0]) for n in os.listdir(folder))


def teacher(folder, dies_at=None):
    """Leaves a file for every call; dies once, before it answers the request ``dies_at``."""

    def answer(seq, prompt):
        if seq == dies_at and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)
        open(f"{folder}/{seq}-{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        if seq % 7 == 0:
            raise TimeoutError("slow")
        return "" if seq % 5 == 0 else f"answer to {prompt}"

    return rs.one_by_one(answer)


def test_a_second_run_asks_nothing(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    first = rs.teacher_map(plan(spark), teacher(str(tmp_path / "calls")), 3, str(tmp_path / "ledger")).collect()
    again = rs.teacher_map(plan(spark), teacher(str(tmp_path / "calls")), 5, str(tmp_path / "ledger")).collect()
    assert sorted(first) == sorted(again) and calls(tmp_path / "calls") == list(range(1, 41))
    assert {r["status"] for r in first} == {"success", "failed", "failed_empty"}
    plain = rs.teacher_map(plan(spark), teacher(str(tmp_path / "calls")), 3).collect()
    assert sorted(plain) == sorted(first) and len(calls(tmp_path / "calls")) == 80


def test_another_prompt_is_another_request(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rs.teacher_map(plan(spark, 4), teacher(str(tmp_path / "calls")), 1, str(tmp_path / "ledger")).collect()
    other = plan(spark, 4).withColumn("prompt", F.when(F.col("seq") == 2, "new").otherwise(F.col("prompt")))
    rows = rs.teacher_map(other, teacher(str(tmp_path / "calls")), 1, str(tmp_path / "ledger")).collect()
    assert calls(tmp_path / "calls") == [1, 2, 2, 3, 4] and {r["response"] for r in rows if r["seq"] == 2} == {"answer to new"}


def test_a_task_that_dies_and_is_run_again(tmp_path):
    """A session of its own, whose tasks may fail: the task dies after half of its requests."""
    script = textwrap.dedent(f"""
        import sys
        sys.path[:0] = [{os.getcwd()!r}, {os.path.dirname(os.path.abspath(__file__))!r}]
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from test_once_only import plan, teacher
        from labelmill.operators import requests as rs
        rows = rs.teacher_map(plan(spark), teacher({str(tmp_path / 'calls')!r}, 20), 1, {str(tmp_path / 'ledger')!r}).collect()
        assert len(rows) == 40, rows
    """)
    (tmp_path / "calls").mkdir()
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert (tmp_path / "calls.died").exists() and calls(tmp_path / "calls") == list(range(1, 41))


def test_calls_of_several_requests(spark, tmp_path):
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def fn(frame):
        open(f"{sizes}/{len(frame)}-{os.urandom(6).hex()}", "w").close()
        return ["ok"] * len(frame)

    assert rs.teacher_map(plan(spark, 10), fn, 1, str(tmp_path / "ledger"), per_call=4).filter("status = 'success'").count() == 10
    assert calls(sizes) == [2, 4, 4]


def test_addresses_of_ledgers(tmp_path):
    for i, form in enumerate(("{}", "file:{}", "file://{}")):
        book = Ledger(form.format(tmp_path / f"l{i}"))
        book.record(1, None, {"response": "é"})
        assert book.root == str(tmp_path / f"l{i}") and book._read(book.place(1, None)) == {"response": "é"}


def test_speculation_is_an_error(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext.getConf().set("spark.speculation", "true")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: conf)
    with pytest.raises(ValueError, match="speculation"):
        rs.teacher_map(plan(spark), lambda f: [], 1, str(tmp_path))


def test_a_batch_is_appended_once(spark, tmp_path, labelled):
    path = str(tmp_path / "samples")
    assert bt.published(spark, path) == {} and wr.read_samples(spark, path).collect() == []
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        assert wr.append_samples(labelled([("a\nb", "x"), ('say "hi"', "y")]), path, fmt, batch="one")
        assert not wr.append_samples(labelled([("other", "x")]), path, fmt, batch="one")
        assert wr.append_samples(labelled([("c", "z")]), path, fmt, batch="two")
        assert sorted(map(tuple, wr.read_samples(spark, path, fmt).collect())) == [("a\nb", "x"), ("c", "z"), ('say "hi"', "y")]
    with pytest.raises(ValueError, match="name"):
        wr.append_samples(labelled([("a", "x")]), path, batch="../up")


def test_a_crash_before_publishing_leaves_nothing(spark, tmp_path, labelled, monkeypatch):
    path = str(tmp_path / "samples")
    publish = bt._publish
    monkeypatch.setattr(bt, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        wr.append_samples(labelled([("a", "x")]), path, batch="one")
    assert os.listdir(f"{path}/data/batch_name=one") and wr.read_samples(spark, path).collect() == []
    monkeypatch.setattr(bt, "_publish", publish)
    assert wr.append_samples(labelled([("a", "x")]), path, batch="one")
    assert [tuple(r) for r in wr.read_samples(spark, path).collect()] == [("a", "x")]


def test_the_first_of_two_writers_counts(spark, tmp_path, labelled, monkeypatch):
    path = str(tmp_path / "samples")
    before = dict(bt.published(spark, path))
    assert wr.append_samples(labelled([("first", "x")]), path, batch="one")
    monkeypatch.setattr(bt, "published", lambda *a: before)  # the second looked before the first had published
    assert not wr.append_samples(labelled([("second", "x")]), path, batch="one")
    monkeypatch.undo()
    assert [r["text"] for r in wr.read_samples(spark, path).collect()] == ["first"]
    assert [n for n in os.listdir(f"{path}/published") if not n.startswith(".")] == ["one.batch"]


def test_logs_by_batches(spark, tmp_path):
    results = rs.teacher_map(plan(spark, 6), rs.one_by_one(lambda s, p: "" if s == 5 else "r"), 2)
    log = str(tmp_path / "log")
    assert wr.log_responses(results, log, batch="w0") and not wr.log_responses(results, log, batch="w0") and wr.log_responses(results, log, batch="w1")
    back = wr.read_responses(spark, log, batches=True)
    assert back.count() == 12 and back.filter("status = 'failed_empty'").count() == 2


def test_a_generation_run_that_is_started_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    classes = spark.createDataFrame([("a", "write a"), ("b", "write b")], "class_label string, prompt string")

    def answer(seq, prompt):
        open(f"{tmp_path}/calls/{seq}-{os.urandom(6).hex()}", "w").close()
        return "\n".join(f"sample number {seq} {i} of the class" for i in range(30))

    def once():
        return gen.generate_training(classes, rs.one_by_one(answer), 100, 50, out=str(tmp_path / "out"), log=str(tmp_path / "log"), run="r1")

    once()
    asked, rows = calls(tmp_path / "calls"), wr.read_samples(spark, str(tmp_path / "out")).count()
    once()
    assert calls(tmp_path / "calls") == asked and len(set(asked)) == len(asked)
    assert wr.read_samples(spark, str(tmp_path / "out")).count() == rows > 0
    assert wr.read_responses(spark, str(tmp_path / "log"), batches=True).count() == len(asked)
