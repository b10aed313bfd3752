"""Each task with each student, trained on small tables in the shape the users bring, trailing blanks included."""

import random

import pytest

from labelmill.operators import metrics as mt
from labelmill.operators import students as st

WORDS = {
    "joy": "happy smile laugh sunny delight", "sadness": "cry tears lonely grey loss", "anger": "furious rage shout angry hate",
}
FAST = {
    ("binary", "mlp"): {"hidden": (8,), "maxIter": 40}, ("binary", "gbt"): {"maxIter": 3, "maxDepth": 3},
    ("multiclass", "mlp"): {"hidden": (8,), "maxIter": 40}, ("multiclass", "logreg"): {"maxIter": 50},
    ("multilabel", "mlp"): {"hidden": (8,), "step": 10, "max_runs": 4, "patience": 1}, ("multilabel", "logreg"): {"maxIter": 50},
}


def texts(rng, labels):
    return " ".join(rng.choice(WORDS[l].split()) for l in labels for _ in range(4))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    names = sorted(WORDS)
    tables = {"binary": [], "multiclass": [], "multilabel": []}
    for i in range(90):
        one = names[i % 3]
        tables["multiclass"].append((i, texts(rng, [one]), one))
        tables["binary"].append((i, texts(rng, [names[i % 2]]), str(i % 2)))
        some = rng.sample(names, 1 + i % 3)
        tables["multilabel"].append((i, texts(rng, some), ", ".join(some) + " "))
    return {k: spark.createDataFrame(v, "row_id bigint, text string, label string").repartition(3).cache() for k, v in tables.items()}


@pytest.mark.parametrize("task, name", sorted(FAST))
def test_student(spark, data, tmp_path, task, name):
    df = data[task]
    student = st.fit(df, task, name, **FAST[task, name])
    scored = st.score(student, df)
    assert scored.count() == df.count()
    labels = {"binary": ["0", "1"]}.get(task, sorted(WORDS))
    assert student.labels == labels
    rows = scored.collect()
    if task == "multilabel":
        assert all(set(filter(None, r["predicted_label"].split(","))) <= set(labels) for r in rows)
        assert all(0 <= r[f"{l}_prob"] <= 1 for r in rows for l in labels)
    else:
        assert all(r["predicted_label"] in labels and 0 <= r["probability"] <= 1 for r in rows)
        assert sum(r["label"] == r["predicted_label"] for r in rows) / len(rows) > 0.9
    assert all(student.history)
    st.save_model(student, str(tmp_path / "m"), spark)
    again = st.score(st.load_model(spark, str(tmp_path / "m")), df)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_nested_scores(data):
    student = st.fit(data["multilabel"], "multilabel", "logreg", maxIter=30)
    for r in st.inference(student)(data["multilabel"]).collect():
        assert set(r["predictions"]) == set(WORDS)
        assert r["predicted_labels"] == [l for l in sorted(WORDS) if r["predictions"][l] > 0.5]


def test_unknown_pairs_are_errors(data):
    with pytest.raises(ValueError, match="no student"):
        st.fit(data["binary"], "binary", "logreg")
    with pytest.raises(ValueError, match="task must be"):
        st.fit(data["binary"], "ranking", "mlp")
    with pytest.raises(ValueError, match="two labels"):
        st.fit(data["binary"].filter("label = '1'"), "binary", "mlp")


def test_students_are_pluggable(data):
    st.register("binary", "plain")(st._TRAINERS["binary", "mlp"])
    try:
        assert st.fit(data["binary"], "binary", "plain", hidden=(4,), maxIter=5).name == "plain"
    finally:
        del st._TRAINERS["binary", "plain"]


def test_label_list_filters_training_rows(data):
    student = st.fit(data["multiclass"], "multiclass", "logreg", labels=["joy", "anger"], maxIter=20)
    assert student.labels == ["anger", "joy"]


def test_run_report(data):
    df = data["multiclass"]
    student, report = st.run(df.filter("row_id < 60"), df.filter("row_id >= 60"), "multiclass", "logreg", maxIter=20)
    rows = report.collect()
    sections = {r["section"] for r in rows}
    assert sections == {"train", "test", "report", "objective"}
    assert {r["name"] for r in rows if r["section"] == "report"} == set(WORDS) | {"accuracy", "macro avg", "weighted avg"}
    assert "test_is_train" in {r["section"] for r in st.run(df, None, "multiclass", "logreg", maxIter=5)[1].collect()}


def test_cross_validation(data):
    df = data["binary"]
    rows = st.cross_validate(df.filter("row_id < 70"), df.filter("row_id >= 70"), "gbt", maxIter=2, maxDepth=2).collect()
    folds = [r for r in rows if r["fold"] is not None]
    assert [r["n_rows"] for r in folds] == [18] * 5
    mean = next(r for r in rows if r["fold"] is None)
    assert mean["accuracy"] == pytest.approx(sum(r["accuracy"] for r in folds) / 5) and mean["n_rows"] == 90


def test_report_against_hand_counts(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "label string, predicted_label string")
    rows = {r["class"]: r for r in mt.classification_report(df).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["support"]) == (0.75, 0.75, 4)
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"]) == (0, 0, 0)
    assert rows["accuracy"]["f1"] == pytest.approx(5 / 7)
    assert rows["macro avg"]["precision"] == pytest.approx((0.75 + 2 / 3) / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(5 / 7)


def test_log_loss_is_nan_with_one_truth_value(spark):
    cells = spark.createDataFrame([("a", 1.0, 0.9), ("a", 1.0, 0.5)], "label string, y double, p double")
    assert mt.multilabel_log_loss(cells).first()["log_loss"] != mt.multilabel_log_loss(cells).first()["log_loss"]


def test_error_sample_shows_what_is_missing(spark):
    rows = [(1, "x" * 20, "a", None, 0.5), (2, None, None, "b", None), (3, "y", "a", "a", 1.0)]
    df = spark.createDataFrame(rows, "row_id int, text string, label string, predicted_label string, a_prob double")
    got = {r["row_id"]: (r["is_correct"], r["line"]) for r in mt.error_sample(df, ["a"]).collect()}
    assert got == {
        1: (False, '- Text: "' + "x" * 20 + '...", True: a, Predicted: null (Probs: a: 0.500)'),
        2: (False, '- Text: "null", True: null, Predicted: b (Probs: a: null)'),
        3: (True, '- Text: "y...", True: a, Predicted: a (Probs: a: 1.000)'),
    }


def test_error_sample_fills_up(spark):
    rows = [(i, "t" * 200, "a", "a" if i % 10 else "b", 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id int, text string, label string, predicted_label string, a_prob double")
    got = mt.error_sample(df, ["a", "b"]).orderBy("row_id").collect()
    assert sum(not r["is_correct"] for r in got) == 4 and len(got) == 20
    assert got[0]["line"] == '- Text: "' + "t" * 150 + '...", True: a, Predicted: b (Probs: a: 0.500)'


def test_the_multilabel_query_trains_with_all_its_runs(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    class Seen(Exception):
        pass

    def fit(*args, **params):
        raise Seen(params)

    monkeypatch.setattr(st, "fit", fit)
    with pytest.raises(Seen) as seen:
        entry.queries()["student_multilabel_mlp"](spark, sf_dir)
    assert not {"max_runs", "step", "patience", "hidden"} & set(seen.value.args[0])
