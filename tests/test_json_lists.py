"""JSON files that hold one list, read in splits of any size, against Python's parser."""

import json
import random

import pytest

from labelmill.sources import json_lists as jl
from labelmill.sources import readers as rd

PARTS = ["a", "}", "{", '"', "\\", "]", "[", "}, {", "\n", "é", "日", ",", " ", "x" * 30, '\\"', "}]"]


@pytest.fixture
def small_splits(spark):
    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def rows(seed, n=20):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))

    return [{"i": i, "t": text(), "o": {"p": text(), "q": [text() for _ in range(rng.randint(0, 2))]}} for i in range(n)]


def got(df):
    return sorted((r["i"], r["t"], r["o"]["p"], list(r["o"]["q"] or [])) for r in df.select("i", "t", "o").collect())


def want(made):
    return sorted((r["i"], r["t"], r["o"]["p"], r["o"]["q"]) for r in made)


@pytest.mark.parametrize("seed, size, indent, ascii_", [(1, 90, None, True), (2, 150, 2, False), (3, 300, None, False), (4, 1 << 20, 1, True)])
def test_lists_in_splits(spark, tmp_path, small_splits, seed, size, indent, ascii_):
    made = rows(seed)
    (tmp_path / "a.json").write_text(" \n" + json.dumps(made, indent=indent, ensure_ascii=ascii_) + "\n \n", encoding="utf-8")
    small_splits(size)
    df, kind = rd.load_data(spark, str(tmp_path / "a.json"))
    assert kind == "json" and got(df) == want(made)
    if size < 200:
        assert jl._chunks(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 8


def test_files_of_all_kinds(spark, tmp_path, small_splits):
    folder = tmp_path / "t.json"
    folder.mkdir()
    parts = [rows(s, 6) for s in (5, 6, 7)]
    (folder / "a.json").write_text(json.dumps(parts[0]))
    (folder / "b b.json").write_text(json.dumps(parts[1], indent=3))
    (folder / "c.json").write_text("\n".join(map(json.dumps, parts[2])) + '\n{"broken')
    (folder / "d.json").write_text(json.dumps({"i": [90], "t": ["col"], "o": [{"p": "", "q": []}]}))
    for size in (150, 1 << 20):
        small_splits(size)
        df = rd.read_json_any(spark, str(folder))
        assert got(df) == sorted(want(parts[0] + parts[1] + parts[2]) + [(90, "col", "", [])])


@pytest.mark.parametrize("text, is_list", [
    ("[]", True), (' [ {"a": 1} ] ', True), ('[{"a": [1, {"b": 2}]}, {"a": "]"}]', True), ('[{"a": 1}]\n[{"a": 2}]', False), ('[{"a": 1}', False),
    ('[{"a": 1}]]', False), ('[{"a": "}]', False), ('{"a": [1]}', None), ('[1]\n{"a": [2]', False),
])
def test_what_is_one_list(spark, tmp_path, small_splits, text, is_list):
    (tmp_path / "a.json").write_text(text)
    for size in (5, 1 << 20):
        small_splits(size)
        assert len(jl.begin_with_bracket(spark, str(tmp_path / "a.json"))) == (is_list is not None)
        verdict = jl.begun(jl.split_reports(spark, str(tmp_path / "a.json")))[1]
        assert list(verdict.values()) == [bool(is_list)]


def test_no_file_is_read_whole(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps(rows(8)))
    small_splits(200)
    asked = []
    plain = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, *a, **k: (asked.append(k.get("wholetext")), plain(self, *a, **k))[1])
    assert rd.read_json_any(spark, str(tmp_path / "a.json")).count() == 20
    assert asked and not any(asked)


def test_a_folder_of_one_kind_is_read_by_its_own_path(spark, tmp_path, monkeypatch):
    """Files of one kind are not listed one by one, nor read once more as whole texts; blank ones and other kinds change nothing."""
    folder = tmp_path / "columns"
    folder.mkdir()
    for i in range(6):
        (folder / f"part {i}.json").write_text(json.dumps({"a": [i, i + 10], "b": ["x", "}"]}) + ("\n" if i % 2 else ""))
    asked, load = [], type(spark.read).text

    def noted(self, paths, *args, **kwargs):
        asked.append((paths, kwargs.get("wholetext")))
        return load(self, paths, *args, **kwargs)

    monkeypatch.setattr(type(spark.read), "text", noted)
    want = sorted((i + k, b) for i in range(6) for k, b in ((0, "x"), (10, "}")))
    assert sorted(map(tuple, rd.read_json_any(spark, str(folder)).select("a", "b").collect())) == want
    assert all(p == str(folder) and not whole for p, whole in asked)
    (folder / "blank.json").write_text(" \n")
    (folder / "empty.json").write_text("")
    assert sorted(map(tuple, rd.read_json_any(spark, str(folder)).select("a", "b").collect())) == want
    (folder / "list.json").write_text('[{"a": 50, "b": "l"}]')
    (folder / "lines.json").write_text('{"a": 60, "b": "m"}\n{"a": 61, "b": "n"}\n')
    (folder / "spread.json").write_text('{"a": [70],\n "b": ["o"]}\n')
    (folder / "broken.json").write_text('{"a": 80, "b": "p"}\n{"a": 81,\n')
    got = sorted(map(tuple, rd.read_json_any(spark, str(folder)).select("a", "b").collect()))
    assert got == want + [(50, "l"), (60, "m"), (61, "n"), (70, "o"), (80, "p")]
