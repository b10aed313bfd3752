from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill.operators import duplicates as dup
from labelmill.operators import labels as lb
from labelmill.operators import profile as pf
from labelmill.plans import prepare as prep
from labelmill.session import bounded, shared_dir
from labelmill.streaming.ingest import stream_samples


def write_csv(tmp_path, rows, header="review_text,category"):
    path = tmp_path / "user.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_prepare_binary_by_first_appearance(spark, tmp_path):
    path = write_csv(tmp_path, [f"text number {i},{'1' if i % 3 == 0 else '0'}" for i in range(9)])
    ready = prep.prepare(spark, path, str(tmp_path / "out"))
    assert ready.decision["final_task"] == "binary" and ready.decision["activation"] == "sigmoid"
    # The first row is labelled 1, so 1 becomes 0.
    assert Counter(r["label"] for r in ready.df.collect()) == {0: 3, 1: 6}
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["text", "label"]


def test_prepare_multilabel_gets_indicator_columns(spark, tmp_path):
    path = write_csv(tmp_path, [f'text number {i},"{l}"' for i, l in enumerate(["a, b", "b", "c,a", "c", "a"])])
    ready = prep.prepare(spark, path, activation="sigmoid")
    assert ready.df.columns == ["row_id", "text", "label_a", "label_b", "label_c", "label"]
    first = ready.df.orderBy("row_id").first()
    assert (first["label_a"], first["label_b"], first["label_c"]) == (1, 1, 0)


def test_prepare_forced_sigmoid_synthesises(spark, tmp_path):
    path = write_csv(tmp_path, [f"text number {i},{'xy'[i % 2]}" for i in range(20)])
    ready = prep.prepare(spark, path, activation="sigmoid")
    assert ready.decision["convert"] == "synthesise"
    assert Counter(r["label"].count(",") for r in ready.df.collect()) == {0: 10, 1: 6}


def test_prepare_softmax_keeps_first_label(spark, tmp_path):
    path = write_csv(tmp_path, ['one text,"a,b"', 'two text,"b,c"', "three text,c"])
    ready = prep.prepare(spark, path, activation="softmax", reply={"task": "multilabel"})
    assert [r["label"] for r in ready.df.orderBy("row_id").collect()] == ["a", "b", "c"]


def test_prepare_cleans_caps_and_balances(spark, tmp_path):
    rows = [f'"  text   {i} ",{"1" if i < 30 else "0"}' for i in range(100)] + ['"   ",1', ",0"]
    path = write_csv(tmp_path, rows)
    ready = prep.prepare(spark, path, clean=True, balance_classes=True, max_samples=40)
    assert Counter(r["label"] for r in ready.df.collect()) == {0: 20, 1: 20}
    assert ready.df.filter(F.col("text").rlike("^ |  | $")).count() == 0
    assert prep.prepare(spark, path, max_samples=17).df.count() == 17


def test_prepare_needs_its_columns(labelled):
    with pytest.raises(ValueError, match="label column"):
        prep.standardise(labelled([("a", "b")]), {"text_column": "text", "label_column": "nope", "final_task": "binary"})


@pytest.mark.parametrize(
    "task, feasible, activation, final, convert",
    [
        ("binary", False, "auto", "binary", None), ("multiclass", True, "auto", "multilabel", None),
        ("binary", False, "sigmoid", "multilabel", "synthesise"), ("multiclass", True, "sigmoid", "multilabel", None),
        ("multilabel", True, "softmax", "multiclass", "first_label"), ("multiclass", True, "softmax", "multiclass", None),
    ],
)
def test_routes(task, feasible, activation, final, convert):
    decision = {
        "task": task, "sigmoid_feasible": feasible, "recommended": "sigmoid" if feasible else "softmax",
        "needs_conversion": False, "conversion_feasible": False,
    }
    routed = prep.route(decision, activation)
    assert (routed["final_task"], routed["convert"]) == (final, convert)


@pytest.mark.parametrize(
    "labels, task, preference, expected",
    [
        (["a", "b"], "binary", "auto", ("sigmoid", "binary_sigmoid", "high")),
        (["a,b", "b"], "multiclass", "auto", ("sigmoid", "multilabel_sigmoid", "high")),
        (["a", "b", "c"], "multiclass", "auto", ("softmax", "multiclass_softmax", "high")),
        (["a", "b", "c"], "multilabel", "auto", ("softmax", "multilabel_softmax", "medium")),
        (["a", "b"], "binary", "softmax", ("softmax", "binary_softmax", "user_specified")),
    ],
)
def test_activation(labelled, labels, task, preference, expected):
    structure = pf.label_structure(labelled([("t", l) for l in labels]))
    assert tuple(pf.detect_activation(structure, task, preference).first())[:3] == expected


def test_own_data(labelled):
    row = prep.own_data_config(labelled([("t", "a, b"), ("t", "b"), ("t", "c")])).first()
    assert (row["classification_type"], row["n_classes"], row["training_data_volume"]) == ("multilabel_sigmoid", 3, 3)


def test_roles_by_name_and_length(spark):
    rows = [(i, f"k{i % 3}", "some rather long text here", "yes" if i % 2 else "no") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, kind string, body string, my_target string")
    row = pf.infer_roles(df, "id").first()
    assert (row["text_column"], row["label_column"], row["task"]) == ("body", "my_target", "binary")
    plain = pf.infer_roles(df.drop("my_target"), "id").first()
    assert (plain["label_column"], plain["task"], plain["sigmoid_feasible"]) == ("kind", "multiclass", True)


def test_value_counts_bounds(spark):
    df = spark.range(3000).select(
        (F.col("id") % 50).cast("int").alias("fifty"), (F.col("id") % 51).alias("more"), F.lit("x").alias("one"),
        F.floor(F.col("id") / 1500).alias("sorted"), F.when(F.col("id") > 2000, F.repeat(F.lit("long"), F.lit(30))).alias("null_or_long"),
        F.when(F.col("id") >= 1000, F.col("id")).alias("late"),
    )
    counts = pf.value_counts(df)
    assert {r[0] for r in counts.select("column_name").distinct().collect()} == {"fifty", "sorted"}
    assert counts.filter("is_top and column_name = 'fifty'").count() == 10
    profile = {r["column_name"]: (r["unique_count"], r["null_count"]) for r in pf.profile(df).collect()}
    assert profile == {"fifty": (50, 0), "more": (51, 0), "one": (1, 0), "sorted": (2, 0), "null_or_long": (1, 2001), "late": (2000, 1000)}


def test_duplicate_report_with_one_hot_text(labelled):
    df = labelled([("Same  text", "a")] * 50 + [(" same  TEXT\n", "a")] * 10 + [(f"other {i}", "a") for i in range(40)])
    row = dup.duplicate_report(df).first()
    assert (row["total_samples"], row["unique_samples"], row["duplicate_rate"], row["exceeds_threshold"]) == (100, 41, 59.0, True)
    assert [tuple(r) for r in dup.duplicate_examples(df).collect()] == [("Same  text", 60)]


def test_duplicate_examples_with_shared_prefix(labelled):
    stem = "p" * 64
    df = labelled([(stem + s, "a") for s in "dcba" for _ in range(2)] + [("zz", "a")] * 2)
    assert [r["example"][-1] for r in dup.duplicate_examples(df).collect()] == ["a", "b", "c"]


def test_threshold_is_compared_before_rounding(labelled):
    # 5.0042 % rounds to 5.0 but exceeds it.
    df = labelled([("same", "a")] * 61 + [(f"t{i}", "a") for i in range(1138)])
    row = dup.duplicate_report(df).first()
    assert row["duplicate_rate"] == 5.0 and row["exceeds_threshold"]


def test_binary_mapping(labelled):
    df = labelled([("t", "z"), ("t", "a"), ("t", "m"), ("t", None)])
    got = [r["label"] for r in lb.to_binary(df).orderBy("row_id").collect()]
    assert got == [0, 1, 0, None]
    assert [r["label"] for r in lb.to_binary(df, order="sorted").orderBy("row_id").collect()] == [0, 0, 1, None]


def test_unseen_test_label_is_an_error(labelled):
    with pytest.raises(ValueError, match="not seen"):
        lb.encode_labels(labelled([("t", "a"), ("t", "b")]), labelled([("t", "c")]))


def test_bounded_sides(spark):
    (small, is_small), (large, is_large_small) = bounded(spark.range(10), 10), bounded(spark.range(11), 10)
    assert is_small and not is_large_small
    assert small.count() == 10 and large.count() == 11
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in large._jdf.queryExecution().executedPlan().toString()


def test_shared_dir_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(lo, hi):
        rows = [(i, "a", "training_data", f'{{"1": "sample text {i}", "2": "x"}}', "success" if i % 5 else "failed") for i in range(lo, hi)]
        schema = "seq bigint, class_label string, prompt_type string, response string, status string"
        spark.createDataFrame(rows, schema).write.mode("append").json(src)

    seen = []
    for lo, hi in ((0, 10), (10, 25)):
        arrive(lo, hi)
        stream_samples(spark, src, out, checkpoint).awaitTermination()
        seen.append(sorted(r["seq"] for r in spark.read.parquet(out).collect()))
    assert seen == [[i for i in range(10) if i % 5], [i for i in range(25) if i % 5]]


def test_very_many_labels(spark):
    df = spark.range(200_000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") % 100_000).cast("string").alias("label")
    )
    with pytest.raises(ValueError, match="more than"):
        lb.to_multilabel(df)
    assert lb.to_label_array(df).columns == ["row_id", "text", "labels", "label"]
    index = lb.label_index(df)
    assert index.count() == 100_000
    assert [r["label"] for r in index.orderBy("idx").limit(3).collect()] == ["0", "1", "10"]
    assert index.agg(F.max("idx")).first()[0] == 99_999
    decision = {"text_column": "text", "label_column": "label", "final_task": "multilabel"}
    assert prep.standardise(df, decision).columns == ["row_id", "text", "labels", "label"] and decision["label_form"] == "array"


def test_folded_labels(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "label string")
    assert tuple(lb.folded_labels(df).first()) == (3, 1)


def test_no_round_robin_between_scan_and_plan(spark, sf_dir):
    import __spark_entry__

    queries = __spark_entry__.queries()
    for name in ("clean_text", "text_stats", "sample_n", "term_counts"):
        assert "RoundRobin" not in queries[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_cleaning_is_done_once(spark, tmp_path):
    """Prepared tables that are written, reported on or sampled from are not cleaned again by each of these."""
    rows = [(i, f"some  text {i}  with \n blanks", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    balanced = prep.prepare_table(df, clean=True, balance_classes=True).df
    assert "regexp_replace" not in plan(balanced)
    assert sorted(r["text"] for r in balanced.collect()) == sorted(f"some text {i} with blanks" for i in range(40))
    df.drop("row_id").write.csv(str(tmp_path / "user.csv"), header=True, escape='"')
    ready = prep.prepare(spark, str(tmp_path / "user.csv"), str(tmp_path / "out"), clean=True, activation="softmax").df
    assert "regexp_replace" not in plan(ready)
    assert sorted(r["text"] for r in ready.collect()) == sorted(r["text"] for r in balanced.collect())
