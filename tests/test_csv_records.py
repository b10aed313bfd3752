"""CSV records with line breaks, read in splits: against Python's reader, for splits of any size."""

import csv
import io
import random

import pytest

from labelmill.sources import csv_records as cr
from labelmill.sources import readers as rd
from labelmill.sources import writers as wr

PARTS = ["a", "b c", '"', '""', "\n", "\n\n", ",", "\t", "é", " ", '5" pipe', "\r\n", "x" * 40, ""]


@pytest.fixture
def small_splits(spark):
    """Splits of some ten bytes, so that records, fields and quotes lie across many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
              if spark.conf.get(k, None) is not None}

    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def table(seed, rows=18):
    rng = random.Random(seed)
    return [["id", "text", "label"]] + [[str(i), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))), rng.choice(["x", "y\nz", ""])] for i in range(rows)]


def written(rows, ends="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ends).writerows(rows)
    return out.getvalue().encode()


def got(df):
    return sorted([tuple(v or "" for v in r) for r in df.collect()], key=lambda r: int(r[0]))


@pytest.mark.parametrize("seed, size, ends", [(1, 13, "\n"), (2, 30, "\r\n"), (3, 90, "\n"), (5, 1 << 20, "\n")])
def test_records_equal_those_of_one_reader(spark, tmp_path, small_splits, seed, size, ends):
    rows = table(seed)
    (tmp_path / "a.csv").write_bytes(written(rows, ends))
    small_splits(size)
    df = cr.read_records(spark, str(tmp_path / "a.csv"))
    assert df.columns == rows[0]
    assert got(df) == [tuple(r) for r in rows[1:]]
    if size < 50:
        assert cr.csv_records(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_records_lie_in_file_order(spark, tmp_path, small_splits):
    rows = table(6)
    (tmp_path / "a.csv").write_bytes(written(rows))
    small_splits(23)
    records = cr.csv_records(spark, str(tmp_path / "a.csv")).orderBy("block", "nth").collect()
    whole = list(csv.reader(io.StringIO(b"\n".join(bytes(r["record"]) for r in records).decode(), newline="")))
    assert whole == rows


def test_many_files_and_a_field_that_stays_open(spark, tmp_path, small_splits):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    parts = [table(s, 6) for s in (7, 8)]
    for i, rows in enumerate(parts):
        (folder / f"{i}.csv").write_bytes(written(rows))
    (folder / "2.csv").write_bytes(b'id,text,label\n90,"one\n\ntwo",x\n\n91,"never\nclosed,y\n')
    for size in (29, 1 << 20):
        small_splits(size)
        rows = got(cr.read_records(spark, str(folder)))
        assert sorted(rows[:-2]) == sorted(tuple(r) for p in parts for r in p[1:])
        assert rows[-2] == ("90", "one\n\ntwo", "x") and rows[-1][0] == "91" and "never\nclosed" in rows[-1][1]


def test_states_of_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'a,b\n"' + b"line\n" * 30 + b'",x\n' + b'1,"p\nq"\n')
    small_splits(10)
    ends = cr.split_ends(spark, str(tmp_path / "a.csv"))
    inside = cr.begun_inside(ends)
    assert len(inside) > 10 and len(set(inside.values())) <= 2
    assert sum(r["through"] for r in ends.collect()) > 10
    assert got(cr.read_records(spark, str(tmp_path / "a.csv"), names=["a", "b"]).filter("a = '1'")) == [("1", "p\nq")]


def test_separators_and_encodings(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('n\tt\n1\t"café, a\nb"\n2\tx, "y\n'.encode("latin-1"))
    small_splits(5)
    df, _ = rd.load_data(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("n", "int"), ("t", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "café, a\nb"), (2, 'x, "y')]


def test_types_are_those_of_the_one_task_reader(spark, tmp_path):
    text = 'i,l,d,day,at,yes,s,none,mixed\n1,5000000000,1.5,2024-01-02,2024-01-02 03:04:05,true,"a\nb",,1\n-2,3,2,2024-02-03,2024-01-02 03:04:06,FALSE,c,,x\n'
    (tmp_path / "a.csv").write_text(text)
    df, _ = rd.load_data(spark, str(tmp_path / "a.csv"))
    plain = spark.read.csv(str(tmp_path / "a.csv"), header=True, inferSchema=True, multiLine=True, escape='"')
    assert df.dtypes == plain.dtypes and sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))


def test_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,,X,"two\nlines"\n1,2,3,4\n')
    assert rd.read_csv_any(spark, str(tmp_path / "a.csv")).columns == ["x0", "_c1", "X2", "two\nlines"]


def test_labelled_and_predictions_with_line_breaks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'text,label\n"a\nb",x\nshort\n"c\n",\nz,too,many\n"d ""q""\n",y\n')
    (tmp_path / "p.csv").write_bytes(b'text,label,predicted_label\n"a\nb",x,y\n')
    for size in (6, 1 << 20):
        small_splits(size)
        assert sorted(map(tuple, rd.read_labelled(spark, str(tmp_path / "a.csv")).collect())) == [("a\nb", "x"), ('d "q"\n', "y")]
        assert [tuple(r) for r in rd.read_predictions(spark, str(tmp_path / "p.csv")).collect()] == [("a\nb", "x", "y")]


def test_round_trip_in_more_tasks_than_files(spark, sf_dir, tmp_path, small_splits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text like '%\n%'")
    wr._csv(docs.coalesce(1), str(tmp_path / "d.csv"), "overwrite")
    small_splits(20_000)
    df, _ = rd.load_data(spark, str(tmp_path / "d.csv"))
    assert df.rdd.getNumPartitions() > 5
    assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError):
        cr.read_records(spark, str(tmp_path / "a.csv"))
