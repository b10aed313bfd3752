"""Queries over features, students, readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from labelmill.functions.text import clean_text, multi_hot, tokenize
from labelmill.operators import features as ft
from labelmill.operators import labels as lb
from labelmill.operators import metrics as mt
from labelmill.operators import students as st
from labelmill.operators.requests import block
from labelmill.operators.sampling import split_validation
from labelmill.plans import prepare as prep
from labelmill.plans.queries_replies import synthesis_sql
from labelmill.plans.registry import (
    DOCS, PREDICTIONS, QUALITY, SEQUENCE, TAG_LABELS, TAGS, TOKENS, docs, predictions, quality, query, sql_key, table, tags,
)
from labelmill.session import materialise, scratch_path
from labelmill.sources import readers as rd
from labelmill.sources import writers as wr


@query("tokenize", f"SELECT row_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM ({DOCS})")
def _(spark, d):
    rows = docs(spark, d).select("row_id", tokenize(F.col("text")).alias("t"))
    return rows.select("row_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


_COUNTS = f"t AS (SELECT row_id, unnest({TOKENS}) AS term FROM ({DOCS})), c AS (SELECT term, count(*) AS cf, count(DISTINCT row_id) AS df FROM t GROUP BY term)"
_VOCAB = f"""{_COUNTS}, k AS (SELECT * FROM c ORDER BY cf DESC, term LIMIT 5000),
  v AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, cf, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM k)"""
_WEIGHTS = f"""{_VOCAB}, tf AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY ALL),
  w AS (SELECT row_id, idx, tf * idf AS w FROM tf JOIN v USING (term)),
  x AS (SELECT row_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM w)"""


@query("term_counts", f"WITH {_COUNTS} SELECT term, cf, df FROM c")
def _(spark, d):
    return ft.term_counts(docs(spark, d))


@query("tfidf_fit", f"WITH {_VOCAB} SELECT term, idx, df, cf, round(idf, 6) AS idf FROM v")
def _(spark, d):
    return ft.tfidf_fit(docs(spark, d)).withColumn("idf", F.round("idf", 6))


@query("tfidf_transform", f"WITH {_WEIGHTS} SELECT row_id, idx, round(w, 6) AS w FROM x")
def _(spark, d):
    rows = docs(spark, d)
    cells = ft.vector_cells(ft.tfidf_transform(rows, ft.tfidf_fit(rows)))
    return cells.withColumn("w", F.round("w", 6))


@query(
    "feature_stats",
    f"""WITH {_WEIGHTS}, s AS (SELECT idx, sum(w) AS s1, sum(w * w) AS s2 FROM x GROUP BY idx), n AS (SELECT count(*) AS n FROM documents)
        SELECT v.idx, v.term, round(coalesce(s1, 0) / n, 6) AS mean, round(sqrt(greatest(coalesce(s2, 0) / n - (coalesce(s1, 0) / n) ** 2, 0)) + 1e-8, 6) AS scale
        FROM v LEFT JOIN s USING (idx), n""",
)
def _(spark, d):
    rows = docs(spark, d)
    vocab = ft.tfidf_fit(rows)
    stats = ft.feature_stats(ft.tfidf_transform(rows, vocab), vocab)
    return stats.select("idx", "term", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


_WORDS = f"""p AS (SELECT row_id, generate_subscripts(s, 1) AS pos, unnest(s) AS term FROM (SELECT row_id, {SEQUENCE} AS s FROM ({DOCS}))),
  g AS (SELECT term, count(*) AS n, min(CAST(row_id AS HUGEINT) * 10000000 + pos) AS first FROM p GROUP BY term),
  v AS (SELECT term, CAST(row_number() OVER (ORDER BY n DESC, first) + 1 AS INTEGER) AS id, n FROM g QUALIFY id < 10000)"""


@query("sequence_fit", f"WITH {_WORDS} SELECT term, id, n FROM v")
def _(spark, d):
    return ft.sequence_fit(docs(spark, d))


@query(
    "to_sequences",
    f"""WITH {_WORDS}, s AS (SELECT row_id, count(*) AS n_ids, md5(string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY pos)) AS digest FROM p LEFT JOIN v USING (term) GROUP BY row_id)
        SELECT doc_id AS row_id, coalesce(n_ids, 0) AS n_ids, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN s ON doc_id = row_id""",
)
def _(spark, d):
    rows = docs(spark, d)
    out = ft.to_sequences(rows, ft.sequence_fit(rows))
    ids = F.array_join(F.transform("sequence", lambda x: x.cast("string")), " ")
    return out.select("row_id", F.size("sequence").cast("bigint").alias("n_ids"), F.md5(ids).alias("digest"))


@query(
    "padded_sequences",
    f"""WITH {_WORDS}, s AS (SELECT row_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN v USING (term) GROUP BY row_id),
          f AS (SELECT doc_id AS row_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN s ON doc_id = row_id)
        SELECT row_id, array_to_string(list_resize(CASE WHEN len(ids) > 30 THEN ids[len(ids) - 29:] ELSE ids END, 30, 0), ' ') AS sequence FROM f""",
)
def _(spark, d):
    rows = docs(spark, d)
    out = ft.padded_sequences(rows, ft.sequence_fit(rows))
    return out.select("row_id", F.array_join(F.transform("sequence", lambda x: x.cast("string")), " ").alias("sequence"))


# --- students: all terms, labels and rows, in their default shapes ----------------------------------------------

# Trees of the boosted students in these queries; `fit` has 500 as default.
TREES = 40


def _split(df):
    marked = split_validation(df, 0.2)
    return marked.filter("not is_validation").drop("is_validation"), marked.filter("is_validation").drop("is_validation")


def _labelled(df):
    return df.withColumn("label", F.col("label").cast("string"))


# The binary task: is a document in English?
_ENGLISH = "SELECT doc_id AS row_id, text, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS label FROM documents"


def _english(spark, d):
    return docs(spark, d).withColumn("label", F.when(F.col("label") == "en", "1").otherwise("0"))


def _held_out(base: str) -> str:
    """SQL of the rows that ``_split`` holds out of a table."""
    return f"""SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (ORDER BY {sql_key()}, row_id) AS rn, count(*) OVER () AS n
        FROM ({base})) WHERE rn <= ceil(n * 0.2)"""


def _judged(base: str) -> str:
    """The held-out rows, and one row without an id that says whether the model is better than a constant answer."""
    return f"SELECT row_id, true AS scored, true AS known FROM ({_held_out(base)}) UNION ALL SELECT NULL, true, true"


def _scored(spark, d, rows, task, student, **params):
    """Every held-out row, whether its probabilities are probabilities, and whether it is given known labels only.

    One more row, without an id, says whether the model beats a constant answer on these rows: of several classes the
    largest by accuracy, and otherwise each label's share among the training rows by log-loss.
    """
    train, test = _split(_labelled(rows))
    fitted = st.fit(train, task, student, partitions=4, **params)
    out = materialise(st.score(fitted, test), "scored")
    probable = [F.col(f"`{c}`").between(0.0, 1.0) for c in out.columns if c == "probability" or c.endswith("_prob")]
    said = F.filter(F.split("predicted_label", ","), lambda x: x != "")
    known = F.size(F.array_except(said, F.array(*map(F.lit, fitted.labels)))) == 0
    judged = out.select("row_id", reduce(lambda x, y: x & y, probable, F.lit(True)).alias("scored"), known.alias("known"))
    if task == "multiclass":
        hits = F.avg((F.col("label") == F.col("predicted_label")).cast("double"))
        largest = out.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
        better = out.agg(hits > largest).first()[0]
    else:
        names = fitted.labels if task == "multilabel" else fitted.labels[1:]
        probs = F.array(*[F.col(f"`{l}_prob`" if task == "multilabel" else "probability") for l in names])
        shares = train.select(multi_hot(F.col("label"), names).alias("t")).agg(*[F.avg(F.col("t")[i]) for i in range(len(names))]).first()
        sides = F.arrays_zip(multi_hot(F.col("label"), names).alias("y"), probs.alias("own"), F.array(*map(F.lit, shares)).alias("share"))
        cells = out.select(F.explode(sides).alias("c"))
        own, constant = (cells.select("c.y", F.col(f"c.{p}").alias("p")).agg(F.avg(mt.cell_log_loss())).first()[0] for p in ("own", "share"))
        better = own < constant
    return judged.unionByName(spark.createDataFrame([(None, better, better)], judged.schema))


@query("student_binary_mlp", _judged(_ENGLISH))
def _(spark, d):
    return _scored(spark, d, _english(spark, d), "binary", "mlp")


@query("student_binary_gbt", _judged(_ENGLISH))
def _(spark, d):
    return _scored(spark, d, _english(spark, d), "binary", "gbt", maxIter=TREES)


@query("student_multiclass_logreg", _judged(DOCS))
def _(spark, d):
    return _scored(spark, d, docs(spark, d), "multiclass", "logreg")


@query("student_multiclass_mlp", _judged(DOCS))
def _(spark, d):
    return _scored(spark, d, docs(spark, d), "multiclass", "mlp")


@query("student_multilabel_logreg", _judged(TAGS))
def _(spark, d):
    return _scored(spark, d, tags(spark, d), "multilabel", "logreg")


@query("student_multilabel_mlp", _judged(TAGS))
def _(spark, d):
    return _scored(spark, d, tags(spark, d), "multilabel", "mlp")


@query(
    "cross_validate",
    f"""WITH r AS (SELECT CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) - 1) * 5 // count(*) OVER (PARTITION BY label) AS INTEGER) AS fold
          FROM ({_ENGLISH}))
        SELECT fold, true AS above_majority, count(*) AS n_rows FROM r GROUP BY fold UNION ALL SELECT NULL, true, count(*) FROM r""",
)
def _(spark, d):
    rows = _english(spark, d)
    train, test = _split(rows)
    folds = st.cross_validate(train, test, "gbt", k=5, partitions=4, maxIter=TREES // 2)
    largest = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    return folds.select("fold", (F.col("accuracy") > largest).alias("above_majority"), "n_rows")


# Rows of a report on held-out documents: classes and averages with their supports, and an accuracy above the largest class's share.
_REPORT = f"""SELECT label AS name, count(*) AS support, true AS possible, NULL AS above_majority FROM h GROUP BY label
    UNION ALL SELECT unnest(['macro avg', 'weighted avg']), (SELECT count(*) FROM h), true, NULL
    UNION ALL SELECT 'accuracy', count(*), true, true FROM h"""


def _checked_report(report, name: str, test):
    largest = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    measures = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1")]
    return report.select(
        *[c for c in report.columns if c == "section"], F.col(name).alias("name"), F.col("support").cast("bigint").alias("support"),
        reduce(lambda x, y: x & y, measures).alias("possible"), F.when(F.col(name) == "accuracy", F.col("f1") > largest).alias("above_majority"),
    )


@query(
    "train_report",
    f"""WITH h AS ({_held_out(DOCS)}) SELECT 'report' AS section, * FROM ({_REPORT})
        UNION ALL SELECT 'test', 'accuracy', count(*), true, true FROM h
        UNION ALL SELECT 'train', 'accuracy', (SELECT count(*) FROM documents) - count(*), true, true FROM h""",
)
def _(spark, d):
    train, test = _split(docs(spark, d))
    report = st.run(train, test, "multiclass", "logreg", partitions=4)[1].filter("section <> 'objective'")
    return _checked_report(report, "name", test)


@query("predict_struct", f"SELECT row_id, CAST({len(TAG_LABELS)} AS INTEGER) AS n_scores, true AS scored FROM ({_held_out(TAGS)})")
def _(spark, d):
    train, test = _split(tags(spark, d))
    predict = st.inference(st.fit(train, "multilabel", "logreg", partitions=4))
    scores = F.map_values("predictions")
    possible = F.forall(scores, lambda p: p.between(0.0, 1.0))
    return predict(test).select("row_id", F.size(scores).alias("n_scores"), possible.alias("scored"))


@query("model_round_trip", f"WITH r AS (SELECT row_id, row_number() OVER (ORDER BY {sql_key()}, row_id) AS rn FROM ({DOCS})) SELECT row_id, true AS same FROM r WHERE rn <= (SELECT ceil(count(*) * 0.2) FROM documents)")
def _(spark, d):
    train, test = _split(docs(spark, d))
    student = st.fit(train, "multiclass", "logreg", partitions=4)
    path = scratch_path(spark, "student")
    st.save_model(student, path, spark)
    again = st.load_model(spark, path)
    before = st.score(student, test).select("row_id", F.col("predicted_label").alias("a"))
    after = st.score(again, test).select("row_id", F.col("predicted_label").alias("b"))
    return before.join(after, "row_id").select("row_id", (F.col("a") == F.col("b")).alias("same"))


@query("language_report", f"WITH h AS ({_held_out(DOCS)}) {_REPORT}")
def _(spark, d):
    """Flagship: clean, featurise, train on 80 %, classify 20 %, report."""
    rows = docs(spark, d).withColumn("text", clean_text(F.col("text")))
    train, test = _split(rows)
    student = st.fit(train, "multiclass", "logreg", partitions=4)
    return _checked_report(mt.classification_report(st.score(student, test)), "class", test)


# --- readers and writers: tables go out to files and come back ----------------------------------------


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    path = scratch_path(spark, "table.csv")
    wr._csv(table(spark, d, "documents"), path, "overwrite")
    loaded, _ = rd.load_data(spark, path)
    return loaded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


@query(
    "tsv_latin1_round_trip",
    r"""SELECT o.*, coalesce(regexp_replace(text, '[^\x{01}-\x{ff}]', '?', 'g'), '') || chr(233) AS text
        FROM orders o LEFT JOIN documents ON o_orderkey = doc_id""",
)
def _(spark, d):
    """All columns of the orders, and the documents' texts in Latin-1, line breaks and tabs included."""
    path = scratch_path(spark, "table.csv")
    orders = table(spark, d, "orders")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("o_orderkey"), F.regexp_replace("text", r"[^\x{01}-\x{ff}]", "?").alias("text"))
    rows = orders.join(texts, "o_orderkey", "left").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("é")))
    rows.select(*orders.columns, "text").write.csv(
        path, header=True, sep="\t", encoding="ISO-8859-1", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    loaded, _ = rd.load_data(spark, path)
    return loaded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in orders.schema], "text")


@query("json_lines_round_trip", "SELECT doc_id, text, lang FROM documents WHERE source <> 'src3'")
def _(spark, d):
    path = scratch_path(spark, "table.json")
    rows = table(spark, d, "documents")
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    # One source's lines are cut off, as in a damaged file.
    broken = F.when(F.col("source") == "src3", F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    loaded, _ = rd.load_data(spark, path)
    return loaded.select("doc_id", "text", "lang")


@query("json_invalid_lines", "SELECT count(*) AS n_lines, count(*) FILTER (source = 'src3') AS n_invalid FROM documents")
def _(spark, d):
    path = scratch_path(spark, "table.json")
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    broken = F.when(F.col("source") == "src3", F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    table(spark, d, "documents").select(broken.alias("value")).write.text(path)
    return rd.count_invalid_lines(spark, path)


def _blocks(spark, d, body):
    """JSON files of up to fifty documents each: a file holds one value, and every scale has many files."""
    path = scratch_path(spark, "table.json")
    rows = table(spark, d, "documents").groupBy(block(F.col("doc_id"), 50).alias("block"))
    body(rows).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return rd.load_data(spark, path)[0].select("doc_id", "text", "lang", "source")


@query("json_list_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, d):
    fields = F.struct("doc_id", "text", "lang", "source")
    return _blocks(spark, d, lambda g: g.agg(F.to_json(F.collect_list(fields)).alias("value")))


@query("json_columns_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, d):
    columns = [F.collect_list(c).alias(c) for c in ("doc_id", "text", "lang", "source")]
    return _blocks(spark, d, lambda g: g.agg(F.to_json(F.struct(*columns)).alias("value")))


_LINE = """CASE lang WHEN 'de' THEN part || chr(9) || lang || chr(9) || 'x' WHEN 'fr' THEN part || ', ' || lang || '  ' WHEN 'es' THEN '"' || part || ', quoted"' ELSE part END"""
_TXT = f"SELECT {_LINE} AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS part FROM documents)"


@query(
    "txt_round_trip",
    rf"""WITH l AS (SELECT trim(line, chr(32) || chr(9) || chr(13)) AS line FROM ({_TXT})), k AS (SELECT line FROM l WHERE line <> '')
        SELECT CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 1) WHEN contains(line, ',') AND NOT starts_with(line, '"')
            THEN trim(regexp_extract(line, '^(.*),([^,]*)$', 1)) ELSE line END AS text,
          CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 2) WHEN contains(line, ',') AND NOT starts_with(line, '"')
            THEN trim(regexp_extract(line, '^(.*),([^,]*)$', 2)) END AS label FROM k""",
)
def _(spark, d):
    path = scratch_path(spark, "table.txt")
    parts = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("part"))
    parts.select(F.expr(_LINE.replace("chr(", "char(")).alias("value")).write.text(path)
    return rd.load_data(spark, path)[0]


@query("labelled_round_trip", "SELECT text, lang AS label FROM documents WHERE lang <> 'es'")
def _(spark, d):
    path = scratch_path(spark, "training")
    rows = docs(spark, d).withColumn("label", F.nullif("label", F.lit("es")))
    wr.append_samples(rows, path, "csv")
    return rd.read_labelled(spark, path)


@query("predictions_round_trip", f"SELECT row_id, text, label, predicted_label FROM ({PREDICTIONS})")
def _(spark, d):
    path = scratch_path(spark, "predictions")
    wr.save_predictions(predictions(spark, d), path)
    return rd.read_predictions(spark, path).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("append_samples", f"SELECT text, label FROM ({DOCS}) UNION ALL SELECT text, role FROM conversations")
def _(spark, d):
    path = scratch_path(spark, "samples")
    wr.append_samples(docs(spark, d), path)
    wr.append_samples(table(spark, d, "conversations").withColumnRenamed("role", "label"), path)
    return spark.read.schema("text string, label string").parquet(path)


@query(
    "save_dataset",
    f"""SELECT 'decision' AS section, 'task' AS name, 'multiclass' AS value UNION ALL SELECT 'shape', 'columns', '3'
        UNION ALL SELECT 'column', 'row_id', 'bigint' UNION ALL SELECT 'column', 'text', 'string' UNION ALL SELECT 'column', 'label', 'string'
        UNION ALL SELECT 'shape', 'rows', CAST(count(*) AS VARCHAR) FROM documents
        UNION ALL SELECT 'label_distribution', label, CAST(count(*) AS VARCHAR) FROM ({DOCS}) GROUP BY label""",
)
def _(spark, d):
    report = wr.save_dataset(docs(spark, d), scratch_path(spark, "prepared"), decision={"task": "multiclass"})
    return spark.read.schema("section string, name string, value string").json(report)


@query("features_round_trip", f"WITH {_VOCAB} SELECT (SELECT count(*) FROM v) AS dimension, count(*) AS n_terms, round(sum(idf), 4) AS idf_sum FROM v")
def _(spark, d):
    rows = docs(spark, d)
    vocab = ft.tfidf_fit(rows)
    path = scratch_path(spark, "features")
    wr.save_features(path, vocab, labels=lb.label_index(rows))
    loaded, size = wr.load_features(spark, path)
    return loaded.agg(F.lit(size).cast("bigint").alias("dimension"), F.count("*").alias("n_terms"), F.round(F.sum("idf"), 4).alias("idf_sum"))


@query("prepare_file", "SELECT trim(replace(regexp_replace(text, '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'), '\"\"', '\"')) AS text, lang AS label FROM documents WHERE text <> ''")
def _(spark, d):
    path = scratch_path(spark, "user.csv")
    wr._csv(table(spark, d, "documents").select("text", "lang"), path, "overwrite")
    ready = prep.prepare(spark, path, scratch_path(spark, "prepared"), clean=True, activation="softmax")
    return ready.df.select("text", "label")


_PLAIN = "trim(replace(regexp_replace(text, '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'), '\"\"', '\"'))"


@query(
    "prepare_balanced",
    f"""WITH f AS (SELECT label, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS code FROM ({QUALITY}) GROUP BY label),
          o AS (SELECT row_id, {_PLAIN} AS text, code AS label FROM ({QUALITY}) JOIN f USING (label)), e AS (SELECT * FROM o WHERE text <> ''),
          c AS (SELECT min(n) AS least, sum(n) AS total FROM (SELECT count(*) AS n FROM e GROUP BY label)),
          r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) AS rn FROM e)
        SELECT row_id, text, label FROM r, c WHERE rn <= least(least, total // 2)""",
)
def _(spark, d):
    flagged = quality(spark, d).withColumnRenamed("label", "quality_label")
    return prep.prepare_table(flagged, clean=True, balance_classes=True).df


_FLAGGED = synthesis_sql(f"SELECT row_id, text, CAST(label AS VARCHAR) AS label FROM ({QUALITY})", most=2)


@query(
    "prepare_multilabel",
    f"""WITH {_FLAGGED} SELECT seq * 4 + kind AS row_id, text, CAST(list_contains(string_split(label, ','), '0') AS INTEGER) AS label_0,
          CAST(list_contains(string_split(label, ','), '1') AS INTEGER) AS label_1, label FROM made""",
)
def _(spark, d):
    base = quality(spark, d).withColumnRenamed("label", "quality_label")
    return prep.prepare_table(base, activation="sigmoid").df
