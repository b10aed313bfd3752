from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill.operators import requests as rs
from labelmill.plans import generate as gen


@pytest.fixture
def classes(spark):
    return spark.createDataFrame([("b", "make b"), ("a", "make a"), ("c", None), ("d", "")], "class_label string, prompt string")


@pytest.mark.parametrize("target, n", [(10, 1), (125, 2), (175, 4)])
def test_plan(classes, target, n):
    rows = rs.with_batches(rs.plan_requests(classes, target), 10).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 2 * n + 1))
    assert [r["class_label"] for r in rows] == ["a"] * n + ["b"] * n
    assert [r["batch"] for r in rows] == [i // 10 for i in range(2 * n)]
    assert {r[0] for r in rs.classes_without_prompt(classes).collect()} == {"c", "d"}


def test_block_is_exact_for_large_numbers(spark):
    big = 2**62 + 7
    row = spark.range(1).select(rs.block(F.lit(big), 15), rs.block(F.lit(-1), 15), rs.block(F.lit(0), 15)).first()
    assert tuple(row) == (big // 15, -1, 0)


def test_teacher_is_asked_once_and_failures_belong_to_their_row(spark, classes):
    calls = spark.sparkContext.accumulator(0)

    def answer(seq, prompt):
        calls.add(1)
        if seq == 3:
            raise RuntimeError("down")
        return "" if seq == 4 else f"{prompt} {seq}"

    rows = rs.teacher_map(rs.plan_requests(classes, 150), rs.one_by_one(answer), 2).collect()
    assert calls.value == len(rows) == 6
    rows = sorted(rows, key=lambda r: r["seq"])
    assert [r["status"] for r in rows] == ["success", "success", "failed", "failed_empty", "success", "success"]
    assert (rows[2]["response"], rows[2]["error"]) == (None, "RuntimeError: down") and rows[4]["response"] == "make b 5"


def test_teacher_that_breaks_is_not_asked_again(spark, classes):
    calls = spark.sparkContext.accumulator(0)

    def teacher(frame):
        calls.add(len(frame))
        raise RuntimeError("gone")

    rows = rs.teacher_map(rs.plan_requests(classes, 150), teacher, 2).collect()
    assert calls.value == len(rows) == 6 and {(r["status"], r["error"]) for r in rows} == {("failed", "RuntimeError: gone")}


def brute_quota(samples, names, target):
    """Batch after batch, checking before each whether every class has enough."""
    have, kept = Counter(), []
    for batch in sorted({b for _, b in samples}):
        if all(have[n] >= target for n in names):
            break
        part = [s for s in samples if s[1] == batch]
        kept += part
        have.update(c for c, _ in part)
    return sorted(kept)


@pytest.mark.parametrize("target", [5, 1000])
@pytest.mark.parametrize("names", [["a", "b"], ["a", "b", "never"]])
def test_quota(spark, target, names):
    samples = [("ab"[(i * i) % 3 % 2], i // 4) for i in range(60)]
    df = spark.createDataFrame(samples, "class_label string, batch bigint")
    listed = spark.createDataFrame([(n,) for n in names], "class_label string")
    assert sorted(map(tuple, rs.apply_quota(df, listed, target).collect())) == brute_quota(samples, names, target)


def test_stats_totals(spark):
    results = spark.createDataFrame(
        [("a", 0, "success"), ("a", 0, "failed"), ("b", 1, "failed_empty")], "class_label string, batch bigint, status string"
    )
    samples = spark.createDataFrame([("a", 0)] * 3, "class_label string, batch bigint")
    rows = {(r["class_label"], r["batch"]): (r["requests"], r["failed"], r["samples"]) for r in rs.generation_stats(results, samples).collect()}
    assert rows == {("a", 0): (2, 1, 3), ("a", None): (2, 1, 3), ("b", 1): (1, 1, 0), ("b", None): (1, 1, 0), (None, None): (3, 2, 3)}


def five(frame):
    return ["\n".join(f"{p} number {s} line {k}" for k in range(5)) for s, p in zip(frame["seq"], frame["prompt"])]


def test_generation_stops_in_waves(spark, classes, tmp_path):
    out = str(tmp_path / "train")
    options = {"volume": 0, "min_per_class": 100, "batch_size": 1}
    many = lambda frame: ["\n".join(f"{p} number {s} line {k}" for k in range(500)) for s, p in zip(frame["seq"], frame["prompt"])]
    waves = gen.generate_training(classes, many, out=out, wave=1, **options)
    # Four requests are planned; the third, the first of class b, meets the target.
    assert waves.stats.filter("class_label is null").first()["requests"] == 3
    assert spark.read.parquet(out).count() == 3 * 500


def test_waves_that_cannot_be_the_last_run_as_one(spark, monkeypatch):
    sent = []
    ask = rs.teacher_map
    monkeypatch.setattr(rs, "teacher_map", lambda part, *rest: sent.append(part.count()) or ask(part, *rest))
    named = spark.createDataFrame([(c, f"Write {c}") for c in "abcd"], "class_label string, prompt string")
    options = {"volume": 0, "min_per_class": 500, "batch_size": 1, "wave": 2}
    fifty = lambda frame: ["\n".join(f"{p} {s} {k}" for k in range(50)) for s, p in zip(frame["seq"], frame["prompt"])]
    # Forty requests; d, the last class, is asked from the 31st on, and the others have their targets by then.
    made = gen.generate_training(named, fifty, **options)
    assert sent == [32, 2, 2, 2, 2] and made.samples.count() == 2000
    # A class that has no request left and no target reached lets nothing stop.
    sent.clear()
    gen.generate_training(named, five, **options)
    assert sent == [32, 8]


def test_teacher_gets_slices_of_prompts(spark):
    sizes = lambda frame: [str(len(frame))] * len(frame)
    plan = spark.range(1, 41).coalesce(1).select(
        F.col("id").alias("seq"), F.lit("a").alias("class_label"), F.lit("t").alias("prompt_type"), F.when(F.col("id") > 1, F.repeat(F.lit("x"), 100_000)).alias("prompt")
    )
    found = {r["seq"]: r["response"] for r in rs.teacher_map(plan, sizes).collect()}
    assert len(found) == 40 and max(int(n) for n in found.values()) <= 11


def test_generation_keeps_all_below_target(classes):
    # A reply brings 5 rows where 50 are expected, so the target is never reached and every sample counts.
    every = gen.generate_training(classes, five, volume=0, min_per_class=100)
    assert every.samples.count() == 20 and every.duplicates.first()["duplicate_count"] == 0


def test_edge_cases_are_skipped_if_present(spark, classes, tmp_path):
    out = str(tmp_path / "edge")
    made = gen.generate_edge_cases(classes, five, "sort letters", "multiclass_softmax", 80, out=out)
    rows = spark.read.parquet(out)
    assert rows.count() == made.samples.count() == 4 * 2 * 5
    assert rows.filter(F.contains("text", F.lit("sort letters"))).count() == rows.count()
    assert gen.generate_edge_cases(classes, five, "x", "y", out=out) is None


def test_multilabel_generation(spark, classes):
    made = gen.generate_multilabel(classes.filter("class_label in ('a', 'b')"), five, volume=0, min_per_class=100)
    assert Counter(r["kind"] for r in made.collect()) == {1: 10, 2: 6}
