import json

import pytest
from pyspark.sql import functions as F

from labelmill.operators.profile import analysis_report
from labelmill.sources import readers as rd
from labelmill.sources import writers as wr


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_comma_quotes_and_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'text,label\n"a, ""b""\nnext line",x\nplain,y\n')
    df, kind = rd.load_data(spark, path)
    assert kind == "csv" and rows(df) == [('a, "b"\nnext line', "x"), ("plain", "y")]


def test_csv_latin1(spark, tmp_path):
    df, _ = rd.load_data(spark, write(tmp_path, "a.csv", "text,label\ncafé,x\n", "latin-1"))
    assert rows(df) == [("café", "x")]
    assert rd.probe_text(spark, write(tmp_path, "b.csv", 'text,label\n"café",x\n')) == ("UTF-8", False)
    assert rd.probe_text(spark, write(tmp_path, "c.csv", 'text,label\n"ca\nfé",x\n')) == ("UTF-8", True)


def test_tsv(spark, tmp_path):
    df, _ = rd.load_data(spark, write(tmp_path, "a.csv", "text\tlabel\na, b\tx\n"))
    assert rows(df) == [("a, b", "x")]


def test_empty_csv_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        rd.load_data(spark, write(tmp_path, "a.csv", ""))


@pytest.mark.parametrize(
    "text, expected",
    [
        (json.dumps([{"t": "a", "l": 1}, {"t": "b", "l": 2}], indent=1), [(1, "a"), (2, "b")]),
        (json.dumps([{"t": "a", "l": 1}, {"t": "b", "l": 2}]), [(1, "a"), (2, "b")]),
        (json.dumps({"t": ["a", "b"], "l": [1, 2]}), [(1, "a"), (2, "b")]),
        (json.dumps({"t": ["a", "b"], "l": [1, 2]}, indent=1), [(1, "a"), (2, "b")]),
        (json.dumps({"t": "a", "l": 1}), [(1, "a")]),
        ('{"t": "a", "l": 1}\n\nbroken\n{"t": "b", "l": 2}\n{"t": "c"', [(1, "a"), (2, "b")]),
        ('broken\n{"t": "b", "l": 2}\n', [(2, "b")]),
    ],
)
def test_json_shapes(spark, tmp_path, text, expected):
    df, kind = rd.load_data(spark, write(tmp_path, "a.json", text))
    assert kind == "json" and rows(df.select("l", "t")) == expected


def test_json_is_judged_file_by_file(spark, tmp_path):
    folder = tmp_path / "many.json"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"t": [f"a{i}", f"b{i}"], "l": [i, i]}))
    expected = [(i, f"{c}{i}") for i in range(3) for c in "ab"]
    assert rows(rd.read_json_any(spark, str(folder)).select("l", "t")) == expected
    (folder / "list.json").write_text(json.dumps([{"t": "x", "l": 7}], indent=1))
    (folder / "lines.json").write_text('{"t": "y", "l": 8}\nbroken\n{"t": "z", "l": 9}\n')
    assert rows(rd.read_json_any(spark, str(folder)).select("l", "t")) == [*expected, (7, "x"), (8, "y"), (9, "z")]


def test_json_lines_count_with_a_bad_line(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"a": 1}\noops\n{"a": 2}\n')
    assert rd.read_json_lines(spark, path).count() == 2


def test_latin1_training_and_predictions(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("text,label,predicted_label\ncafé,x,y\n".encode("latin-1"))
    assert rows(rd.read_predictions(spark, str(path))) == [("café", "x", "y")]
    path = tmp_path / "t.csv"
    path.write_bytes("text,label\ncafé,x\n".encode("latin-1"))
    assert rows(rd.read_labelled(spark, str(path))) == [("café", "x")]


@pytest.mark.parametrize(
    "text, multiline",
    [('a,b\n5" pipe,x\n', False), ('a,b\n"q, r",x\n', False), ('a,b\n"one\ntwo",x\n', True), ('a,b\n"say ""hi""",x\n', False), ('a,b\nx,"one\n\ntwo"\n', True), ('a,b\n"' + 'word ""x"" ' * 20000 + '",y\n', False)],
)
def test_quotes_that_span_lines(spark, tmp_path, text, multiline):
    assert rd.probe_text(spark, write(tmp_path, "q.csv", text)) == ("UTF-8", multiline)


def test_json_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        rd.load_data(spark, write(tmp_path, "a.json", "nothing\nvalid\n"))
    uneven = rd.read_json_any(spark, write(tmp_path, "b.json", '{"t": ["a"], "l": [1, 2]}'))
    with pytest.raises(Exception, match="differ in length"):
        uneven.collect()


def test_json_invalid_count(spark, tmp_path):
    path = write(tmp_path, "a.json", '{"a": 1}\n\n oops \n{"b"')
    assert tuple(rd.count_invalid_lines(spark, path).first()) == (3, 2)


def test_txt(spark, tmp_path):
    text = 'a\tx\textra\n\n  b, c , y \n"q, r", z\nbare\n \t \n'
    df, kind = rd.load_data(spark, write(tmp_path, "a.txt", text))
    assert kind == "txt"
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [("a", "x"), ("b, c", "y"), ('"q, r", z', None), ("bare", None)], key=str
    )


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        rd.load_data(spark, "/tmp/data.xlsx")


def test_labelled_drops_bad_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'text,label\na,x\nb\n,y\nc,z,too,many\n"d, e",w\n')
    assert rows(rd.read_labelled(spark, path)) == [("a", "x"), ("d, e", "w")]


def test_predictions_need_their_columns(spark, tmp_path):
    good = write(tmp_path, "a.csv", "text,label,predicted_label\na,x,y\n")
    assert rows(rd.read_predictions(spark, good)) == [("a", "x", "y")]
    with pytest.raises(ValueError, match="predicted_label"):
        rd.read_predictions(spark, write(tmp_path, "b.csv", "text,label\na,x\n"))


def test_save_dataset_and_report(spark, tmp_path, labelled):
    df = labelled([('say "hi", you', "a"), ("plain", "b"), (" spaced ", "b")]).drop("row_id")
    for fmt, clean in (("csv", False), ("parquet", False)):
        path = str(tmp_path / fmt)
        report = wr.save_dataset(df, path, clean, fmt, {"task": "multiclass"})
        back = spark.read.csv(path, header=True, escape='"') if fmt == "csv" else spark.read.parquet(path)
        assert rows(back) == rows(df)
        entries = {(r["section"], r["name"]): r["value"] for r in spark.read.json(report).collect()}
        assert entries["shape", "rows"] == "3" and entries["label_distribution", "b"] == "2"
    path = str(tmp_path / "clean")
    wr.save_dataset(df, path, True, "csv")
    assert rows(spark.read.csv(path, header=True, escape="\\")) == rows(df)


def test_append_and_log(spark, tmp_path, labelled):
    path = str(tmp_path / "samples")
    for fmt in ("csv", "parquet"):
        for part in (["a"], ["b", "c"]):
            wr.append_samples(labelled([(t, "x") for t in part], 1), f"{path}_{fmt}", fmt)
    assert rows(spark.read.csv(f"{path}_csv", header=True)) == rows(spark.read.parquet(f"{path}_parquet")) == [("a", "x"), ("b", "x"), ("c", "x")]
    results = spark.createDataFrame(
        [(1, 0, "a", "training_data", "p", "r", "success"), (2, 0, "a", "training_data", "p", "e", "failed")],
        "seq bigint, batch bigint, class_label string, prompt_type string, prompt string, response string, status string",
    )
    log = str(tmp_path / "log")
    wr.log_responses(results, log)
    wr.log_responses(results, log)
    back = wr.read_responses(spark, log)
    assert back.count() == 4 and back.filter("status = 'failed' and logged_at is not null").count() == 2
    plan = back.filter("status = 'failed'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_report_lists_every_label(spark):
    df = spark.range(1000).select(F.lit("t").alias("text"), F.col("id").cast("string").alias("label"))
    assert analysis_report(df).filter("section = 'label_distribution'").count() == 1000
