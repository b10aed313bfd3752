import json

import pytest
from pyspark.sql import functions as F

from labelmill.functions import replies as rp
from labelmill.operators import replies as rq

# Replies and the samples in them.
REPLIES = {
    '{"1": "a good long sample", "2": "short", "3": "  \\"quoted long text\\"  "}': ["a good long sample", "quoted long text"],
    'Sure!\n```json\n{"1": "fenced sample text"}\n```\nbye {x}': [],
    'Sure!\n```json\n{"1": "fenced sample text"}\n```\nbye': ["fenced sample text"],
    '{"1": "first version here", "1": "second version here"}': ["second version here"],
    '{"1": "broken json here", }': [],
    '{"1": "one object here"} and {"2": "another object"}': [],
    '"1": "pair one", "2": "", "3": "ends\\", "10" : "x"': ["pair one", "x"],
    'first plain line of text\n\n  "second plain line"  \nshort\n} odd line with brace': ["first plain line of text", "second plain line", "} odd line with brace"],
    "} reversed {": [],
    "{'1': 'single quotes are not json'}": [],
    '{"1": null, "2": true, "3": 12345678901, "4": "plain value text"}': ["12345678901", "plain value text"],
    "": [],
    '{"a": "tab\\tand newline\\nkept inside"}': ["tab\tand newline\nkept inside"],
}


def test_sample_texts_follow_the_rules(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "r string")
    got = {r["r"]: r["s"] or [] for r in df.select("r", rp.sample_texts(F.col("r")).alias("s")).collect()}
    for reply, samples in REPLIES.items():
        assert got[reply] == samples, reply


def test_long_reply_with_repeated_keys(spark):
    body = "{" + ", ".join(f'"{i % 5000}": "value number {i} of many"' for i in range(10_000)) + "}"
    df = spark.createDataFrame([(body,)], "r string")
    got = df.select(rp.sample_texts(F.col("r"))).first()[0]
    assert sorted(got) == sorted(f"value number {i} of many" for i in range(5000, 10_000))


def test_failed_results_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, "a", "a good long sample", "success"), (2, "a", "a good long sample", "failed")],
        "seq int, class_label string, response string, status string",
    )
    assert [r["seq"] for r in rq.parse_samples(df).collect()] == [1]


def test_fence(spark):
    cases = {
        "x ```json {a} ``` y ```": "{a}",
        "no fence ": "no fence",
        "``` {a} ```": "",
        "before ```{a}```": "before",
        "```json a ```json b": "a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    assert {r[0]: r[1] for r in df.select("r", rp.strip_fence(F.col("r"))).collect()} == cases


GOOD = {
    "summary": "s", "classification_type": "binary_sigmoid", "class_labels": ["b", "a", "b"],
    "prompts": {"a": "x", "b": "y"}, "model_prefix": "m", "training_data_volume": 500,
}


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, []),
        ({"summary": None, "_drop": "summary"}, ["missing_keys"]),
        ({"class_labels": []}, ["no_class_labels"]),
        ({"class_labels": "a"}, ["no_class_labels"]),
        ({"prompts": {"a": "x"}}, ["prompt_keys_differ"]),
        ({"prompts": "x"}, ["prompt_keys_differ"]),
        ({"class_labels": ["a"], "prompts": {"a": "x"}}, ["fewer_than_two_labels"]),
    ],
)
def test_parse_config(spark, change, errors):
    config = GOOD | change
    if "_drop" in config:
        config.pop(config.pop("_drop"))
    df = spark.createDataFrame([("```json\n" + json.dumps(config) + "\n```",)], "response string")
    row = rq.parse_config(df).first()
    assert row["errors"] == errors
    if not errors:
        assert row["config"]["class_labels"] == ["a", "b"] and row["config"]["training_data_volume"] == 500


def test_parse_config_rejects_prose(spark):
    df = spark.createDataFrame([("no json",), ('{"a": 1} {"b": 2}',)], "response string")
    assert [r["errors"] for r in rq.parse_config(df).collect()] == [["invalid_json"]] * 2


def test_refinement(spark):
    configs = spark.createDataFrame([(i, {"a": "old a", "b": "old b"}) for i in range(4)], "config_id int, prompts map<string,string>")
    new = {"evaluation_summary": "ok", "refined_prompts": {"a": "new a", "b": "old b"}}
    replies = spark.createDataFrame(
        [(0, json.dumps(new)), (1, "nothing"), (2, json.dumps(new | {"refined_prompts": {"a": "x"}}))],
        "config_id int, response string",
    )
    rows = {(r["config_id"], r["class_label"]): r for r in rq.apply_refinement(configs, replies).collect()}
    assert rows[0, "a"]["prompt"] == "new a" and rows[0, "a"]["changed"] and not rows[0, "b"]["changed"]
    for i in (1, 2, 3):
        assert rows[i, "a"]["prompt"] == "old a" and not rows[i, "a"]["accepted"]
    history = rq.refinement_history(rq.apply_refinement(configs, replies), 2).filter("config_id = 0").first()
    assert history["previous_prompts"] == {"a": "old a", "b": "old b"} and history["refined_prompts"]["a"] == "new a"


def test_assignments(spark, labelled):
    rows = rq.labelling_batches(labelled([(f"t{i}", "ab"[i % 2]) for i in range(9)]), 3)
    replies = spark.createDataFrame(
        [
            (0, 'Done: {"0": ["b", "zz", "b"], "2": ["zz"], "7": ["a"], "x": ["a"]}'),
            (1, "no idea"),
        ],
        "batch bigint, response string",
    )
    got = {(r["row_id"], r["label"]) for r in rq.apply_assignments(rows, replies, ["a", "b"]).collect()}
    # Row 1 is missing from the answer, row 2 keeps its label, batches 1 and 2 keep their rows.
    assert got == {(0, "b,b"), (2, "a"), (3, "b"), (4, "a"), (5, "b"), (6, "a"), (7, "b"), (8, "a")}


def test_preview(spark):
    results = spark.createDataFrame(
        [(1, "a", " one \n\n two", "success"), (2, "a", "three\nfour", "success"), (3, "b", "x", "failed")],
        "seq int, class_label string, response string, status string",
    )
    classes = spark.createDataFrame([("a",), ("b",)], "class_label string")
    got = {r[0]: r[1] for r in rq.preview_by_class(results, classes).collect()}
    assert got == {
        "a": "* Samples for Class 'a':\n  - one...\n  - two...\n  - three...",
        "b": "* Samples for Class 'b': No samples generated.",
    }
