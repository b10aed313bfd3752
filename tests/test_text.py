import re

from pyspark.sql import functions as F

from labelmill.functions import text as tx

TEXTS = [
    None, "", "  a\t b\r\nc  ", 'say ""hi"" now', '"quoted"', ' "a" b" ', "x  y　", "\x1c\x1dz\x85", "Ünï-cödé  Straße",
    "The Analysis of a Classification: for_the an apple", "of the a", "a" * 250, "___", "it's self-made, 3.14 x_y A1", "ab\tcd",
]


def _apply(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def _clean(t):
    return "" if t is None else re.sub(r"\s+", " ", t).replace('""', '"').strip()


def test_clean_text(spark):
    assert _apply(spark, tx.clean_text) == [_clean(t) for t in TEXTS]


def test_unquote_and_key(spark):
    assert _apply(spark, tx.unquote) == [None if t is None else t.strip().strip('"') for t in TEXTS]
    assert _apply(spark, tx.norm_key) == [None if t is None else t.strip().lower() for t in TEXTS]


def test_ellipsis_modes(spark):
    long = "a" * 250
    cut = _apply(spark, lambda c: tx.ellipsis(c, 100))
    assert cut[TEXTS.index(long)] == "a" * 100 + "..." and cut[4] == '"quoted"'
    assert _apply(spark, lambda c: tx.ellipsis(c, 3, "always"))[4] == '"qu...'
    assert _apply(spark, lambda c: tx.ellipsis(c, 3, "never"))[4] == '"qu'


def test_slug(spark):
    stop = set(tx.SLUG_STOP_WORDS)

    def expect(t):
        kept = "".join(w for w in re.findall(r"\w+|\W+", t.lower()) if w not in stop)
        name = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", kept).strip())
        return re.sub("_+", "_", name).strip("_")[:30] or "user_dataset"

    got = _apply(spark, tx.slug)
    assert got[0] == "user_dataset"
    assert got[1:] == [expect(t) for t in TEXTS[1:]]


def test_tokens(spark):
    assert _apply(spark, tx.tokenize) == [None if t is None else re.findall(r"\b\w\w+\b", t.lower()) for t in TEXTS]
    table = str.maketrans(dict.fromkeys(tx.SEQUENCE_FILTERS, " "))
    expect = [None if t is None else [w for w in t.lower().translate(table).split(" ") if w] for t in TEXTS]
    assert _apply(spark, tx.sequence_tokens) == expect


def test_labels_split_and_hot(spark):
    df = spark.createDataFrame([(" a, b ,,c ",), ("surprise ",), ("b",)], "l string")
    assert [r[0] for r in df.select(tx.split_labels(F.col("l"))).collect()] == [["a", "b", "c"], ["surprise"], ["b"]]
    assert [r[0] for r in df.select(tx.multi_hot(F.col("l"), ["a", "b", "surprise"])).collect()] == [
        [1.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0],
    ]


def test_correctness_flag_counts_nulls_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, None)], "l string, p string")
    assert [r[0] for r in df.select(tx.is_correct(F.col("l"), F.col("p"))).collect()] == [True, False, False, False]
