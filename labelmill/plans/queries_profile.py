"""Queries over profiles, duplicates, decisions, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.text import clean_text
from labelmill.operators import duplicates as dup
from labelmill.operators import metrics as mt
from labelmill.operators import profile as pf
from labelmill.operators import sampling as sm
from labelmill.operators.students import project_scores, struct_scores
from labelmill.plans import prepare as prep
from labelmill.plans.registry import (
    DOCS, LANGS, PREDICTIONS, QUALITY, TAG_LABELS, TAGS, WS, docs, predictions, quality, query, sql_key, sql_strip,
    sql_unit, table, tags, unit,
)

_NORM = f"lower({sql_strip('text')})"


def _profile_sql(table_name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(DISTINCT {c}) AS unique_count, "
        f"count(*) - count({c}) AS null_count FROM {table_name}"
        for c, t in columns.items()
    )


_DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query("profile", _profile_sql("documents", _DOC_TYPES))
def _(spark, d):
    return pf.profile(table(spark, d, "documents"))


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@query("profile_sketch", f"SELECT column_name, data_type, null_count, true AS close FROM ({_profile_sql('orders', _ORDER_TYPES)})")
def _(spark, d):
    """Sketched distinct counts are within 5 % of the exact ones."""
    rows = table(spark, d, "orders")
    exact = pf.profile(rows).select("column_name", F.col("unique_count").alias("exact"))
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return pf.profile(rows, exact=False).join(exact, "column_name").select("column_name", "data_type", "null_count", close.alias("close"))


@query(
    "value_counts",
    """WITH v AS (FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE value)),
       c AS (SELECT column_name, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
       k AS (SELECT column_name FROM c GROUP BY column_name HAVING count(*) BETWEEN 2 AND 50)
       SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) <= 10 AS is_top
       FROM c JOIN k USING (column_name)""",
)
def _(spark, d):
    return pf.value_counts(table(spark, d, "lineitem"))


@query(
    "text_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(length({c})), 6) AS mean_length, max(length({c})) AS max_length, "
        f"avg(length({c})) > 100 AS is_text FROM documents"
        for c in ("text", "lang", "source")
    ),
)
def _(spark, d):
    stats = pf.text_stats(table(spark, d, "documents"))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query(
    "text_samples",
    " UNION ALL ".join(
        f"(SELECT doc_id, '{c}' AS column_name, substring({c}, 1, 200) AS sample FROM documents ORDER BY doc_id LIMIT 3)"
        for c in ("text", "lang")
    ),
)
def _(spark, d):
    return pf.text_samples(table(spark, d, "documents"), ["text", "lang"], "doc_id")


@query("label_distribution", f"SELECT label, count(*) AS n FROM ({DOCS}) GROUP BY label")
def _(spark, d):
    return pf.label_distribution(docs(spark, d))


@query(
    "duplicate_report",
    f"""WITH c AS (SELECT count(*) AS total, count(DISTINCT {_NORM}) AS uniq FROM documents)
        SELECT total AS total_samples, uniq AS unique_samples, total - uniq AS duplicate_count,
          round((total - uniq) / total * 100, 2) AS duplicate_rate, CAST(5.0 AS DOUBLE) AS threshold,
          (total - uniq) / total * 100 > 5.0 AS exceeds_threshold FROM c""",
)
def _(spark, d):
    return dup.duplicate_report(docs(spark, d))


@query(
    "duplicate_warning",
    f"""WITH c AS (SELECT count(*) AS total, count(DISTINCT lower({sql_strip("source")})) AS uniq FROM documents)
        SELECT total AS total_samples, uniq AS unique_samples, total - uniq AS duplicate_count,
          round((total - uniq) / total * 100, 2) AS duplicate_rate, CAST(50.0 AS DOUBLE) AS threshold,
          true AS exceeds_threshold, 'sources' AS dataset FROM c WHERE (total - uniq) / total * 100 > 50.0""",
)
def _(spark, d):
    return dup.duplicate_warning(dup.duplicate_report(table(spark, d, "documents"), 50.0, "source"), "sources")


@query(
    "duplicate_examples",
    f"""WITH g AS (SELECT {_NORM} AS k, arg_min(text, doc_id) AS t, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
        SELECT CASE WHEN length(t) > 100 THEN substring(t, 1, 100) || '...' ELSE t END AS example, n AS copies
        FROM g ORDER BY k LIMIT 3""",
)
def _(spark, d):
    return dup.duplicate_examples(docs(spark, d))


_STRUCTURE = f"""WITH t AS ({TAGS}), w AS (SELECT bool_or(contains(label, ',')) AS has_comma, bool_or(contains(label, '|')) AS has_pipe,
        bool_or(contains(label, ';')) AS has_semicolon, avg(length(label) - length(replace(label, ',', '')) + 1) AS m,
        count(DISTINCT label) AS whole, count(*) AS total_rows FROM t),
     p AS (SELECT count(DISTINCT part) AS parts FROM (SELECT {sql_strip("unnest(string_split(label, ','))")} AS part FROM t)),
     s AS (SELECT has_comma, has_pipe, has_semicolon, CASE WHEN has_comma THEN m ELSE 1.0 END AS mean_labels,
        CASE WHEN has_comma THEN parts ELSE whole END AS unique_labels, total_rows,
        has_comma OR has_pipe OR has_semicolon AS has_indicators FROM w, p)"""


@query(
    "label_structure",
    f"{_STRUCTURE} SELECT has_comma, has_pipe, has_semicolon, round(mean_labels, 6) AS mean_labels, unique_labels, total_rows, has_indicators FROM s",
)
def _(spark, d):
    return pf.label_structure(tags(spark, d)).withColumn("mean_labels", F.round("mean_labels", 6))


@query("individual_labels", f"SELECT DISTINCT {sql_strip('part')} AS label FROM (SELECT unnest(string_split(label, ',')) AS part FROM ({TAGS})) WHERE {sql_strip('part')} <> ''")
def _(spark, d):
    return pf.individual_labels(tags(spark, d))


@query(
    "label_cardinality",
    f"""WITH c AS (SELECT CAST(len(string_split(label, ',')) AS BIGINT) AS n_labels, count(*) AS n_rows FROM ({TAGS}) GROUP BY 1)
        SELECT n_labels, n_rows, round((SELECT sum(CASE WHEN n_labels > 1 THEN n_rows ELSE 0 END) / sum(n_rows) FROM c), 6) AS multi_share FROM c""",
)
def _(spark, d):
    return pf.label_cardinality(tags(spark, d)).withColumn("multi_share", F.round("multi_share", 6))


@query(
    "newline_check",
    f"""SELECT 'raw' AS stage, count(*) AS n_rows, count(*) FILTER (contains(text, chr(10))) AS with_newline FROM documents
        UNION ALL SELECT 'clean', count(*), count(*) FILTER (contains(regexp_replace(text, '{WS}+', ' ', 'g'), chr(10))) FROM documents""",
)
def _(spark, d):
    raw = docs(spark, d)
    clean = raw.select(clean_text(F.col("text")).alias("text"))
    return pf.newline_check(raw).select(F.lit("raw").alias("stage"), "*").unionByName(
        pf.newline_check(clean).select(F.lit("clean").alias("stage"), "*")
    )


@query(
    "analysis_report",
    f"""SELECT 'shape' AS section, 'columns' AS name, '3' AS value UNION ALL SELECT 'column', 'row_id', 'bigint'
        UNION ALL SELECT 'column', 'text', 'string' UNION ALL SELECT 'column', 'label', 'string'
        UNION ALL SELECT 'decision', 'task', 'multiclass'
        UNION ALL SELECT 'shape', 'rows', CAST(count(*) AS VARCHAR) FROM documents
        UNION ALL SELECT 'label_distribution', label, CAST(count(*) AS VARCHAR) FROM ({DOCS}) GROUP BY label""",
)
def _(spark, d):
    return pf.analysis_report(docs(spark, d), {"task": "multiclass"})


@query(
    "infer_roles",
    """SELECT 'text' AS text_column, 'lang' AS label_column, CASE WHEN n >= 3 THEN 'multiclass' ELSE 'binary' END AS task,
         n >= 3 AS sigmoid_feasible, true AS softmax_feasible, CASE WHEN n >= 3 THEN 'sigmoid' ELSE 'softmax' END AS recommended,
         CAST(60 AS BIGINT) AS confidence FROM (SELECT count(DISTINCT lang) AS n FROM documents)""",
)
def _(spark, d):
    return pf.infer_roles(table(spark, d, "documents"), "doc_id")


@query(
    "infer_roles_unnamed",
    """WITH m AS (SELECT avg(length(html)) AS h FROM (SELECT html FROM pages ORDER BY page_id LIMIT 10)),
            u AS (SELECT avg(length(url)) AS h FROM (SELECT url FROM pages ORDER BY page_id LIMIT 10)),
            n AS (SELECT count(DISTINCT kind) AS n FROM (SELECT html LIKE '%<table%' AS kind FROM pages))
       SELECT CASE WHEN u.h > 20 THEN 'url' WHEN m.h > 20 THEN 'html' ELSE 'url' END AS text_column,
         CASE WHEN n BETWEEN 2 AND 10 THEN 'kind' END AS label_column, 'binary' AS task, false AS sigmoid_feasible,
         true AS softmax_feasible, 'softmax' AS recommended, CAST(60 AS BIGINT) AS confidence FROM m, u, n""",
)
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("kind", F.contains("html", F.lit("<table")))
    return pf.infer_roles(pages, "page_id")


@query(
    "detect_activation",
    f"""{_STRUCTURE} SELECT CASE WHEN has_comma OR mean_labels > 1.2 THEN 'sigmoid' ELSE 'softmax' END AS activation,
        CASE WHEN has_comma OR mean_labels > 1.2 THEN 'multilabel_sigmoid' ELSE 'multiclass_softmax' END AS final_type,
        CASE WHEN has_comma THEN 'high' WHEN mean_labels > 1.2 THEN 'medium' ELSE 'high' END AS confidence, unique_labels FROM s""",
)
def _(spark, d):
    return pf.detect_activation(pf.label_structure(tags(spark, d)), "multiclass")


@query(
    "infer_task",
    """SELECT 'tags' AS source, 'multilabel' AS task UNION ALL
       SELECT 'quality', CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'multiclass' END FROM labels UNION ALL
       SELECT 'lang', CASE WHEN count(DISTINCT lang) = 2 THEN 'binary' ELSE 'multiclass' END FROM documents""",
)
def _(spark, d):
    inputs = {"tags": tags(spark, d), "quality": spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "label"), "lang": docs(spark, d)}
    parts = [pf.infer_task(df).select(F.lit(k).alias("source"), "task") for k, df in inputs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "own_data_config",
    """SELECT 'User-provided dataset for multiclass_softmax classification' AS summary, 'multiclass_softmax' AS classification_type,
         'softmax' AS activation, 'high' AS confidence, 'user_dataset_multiclass_softmax' AS model_prefix,
         count(DISTINCT lang) AS n_classes, count(*) AS training_data_volume FROM documents""",
)
def _(spark, d):
    return prep.own_data_config(docs(spark, d))


# --- sampling --------------------------------------------------------------------------------


@query("sample_n", f"SELECT * FROM ({DOCS}) ORDER BY {sql_key()}, row_id LIMIT 200")
def _(spark, d):
    return sm.sample_n(docs(spark, d), 200)


@query(
    "sample_per_class",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) AS rn,
          count(*) OVER (PARTITION BY label) AS n FROM ({DOCS}))
        SELECT row_id, text, label FROM r WHERE rn <= n // 2""",
)
def _(spark, d):
    base = docs(spark, d)
    quota = base.groupBy(F.col("label").alias("grp")).agg(F.floor(F.count("*") / 2).alias("rank"))
    return sm.first_by_hash(base, F.col("label"), quota)


@query("shuffle", f"SELECT row_id, {sql_key()} AS sort_key FROM ({DOCS})")
def _(spark, d):
    return sm.shuffle(docs(spark, d)).select("row_id", sm.hash_key("row_id").alias("sort_key"))


@query("preview", f"SELECT * FROM ({DOCS}) ORDER BY row_id LIMIT 5")
def _(spark, d):
    return sm.preview(docs(spark, d), 5)


@query(
    "balance",
    f"""WITH c AS (SELECT min(n) AS least, sum(n) AS total FROM (SELECT count(*) AS n FROM ({QUALITY}) GROUP BY label)),
          r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) AS rn FROM ({QUALITY}))
        SELECT row_id, text, label FROM r, c WHERE rn <= least(least, total // 2)""",
)
def _(spark, d):
    return sm.balance(quality(spark, d))


@query(
    "split_validation",
    f"""WITH r AS (SELECT row_id, label, row_number() OVER (ORDER BY {sql_key()}, row_id) AS rn FROM ({DOCS}))
        SELECT row_id, label, rn <= (SELECT ceil(count(*) * 0.2) FROM documents) AS is_validation FROM r""",
)
def _(spark, d):
    return sm.split_validation(docs(spark, d)).drop("text")


@query(
    "stratified_folds",
    f"""WITH r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) AS rn,
          count(*) OVER (PARTITION BY label) AS n FROM ({DOCS}))
        SELECT row_id, label, CAST((rn - 1) * 5 // n AS INTEGER) AS fold FROM r""",
)
def _(spark, d):
    return sm.stratified_folds(docs(spark, d)).drop("text")


@query(
    "profile_sample",
    """WITH l AS (SELECT source, min(doc_id) AS f, count(*) OVER () AS c FROM documents GROUP BY source),
         s AS (SELECT * FROM l ORDER BY f LIMIT 10),
         r AS (SELECT d.*, f, c, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS rn FROM documents d JOIN s ON d.source = s.source)
       SELECT doc_id, text, lang, source, n_chars FROM r WHERE rn <= greatest(2, 10 // least(c, 10)) ORDER BY f, doc_id LIMIT 8""",
)
def _(spark, d):
    return sm.profile_sample(table(spark, d, "documents"), "source", row_id="doc_id")


@query(
    "union_splits",
    f"""SELECT row_id, label, 'train' AS split FROM ({DOCS}) WHERE row_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT row_id, label, 'test' FROM ({DOCS}) WHERE row_id IN (SELECT doc_id FROM labels)""",
)
def _(spark, d):
    base = docs(spark, d).drop("text")
    known = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("row_id"))
    return sm.union_splits(base.join(known, "row_id", "left_anti"), base.join(known, "row_id", "left_semi"))


# --- metrics ---------------------------------------------------------------------------------


@query(
    "accuracy",
    f"SELECT round(avg(CASE WHEN label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows FROM ({PREDICTIONS})",
)
def _(spark, d):
    return mt.accuracy(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "classification_report",
    f"""WITH p AS ({PREDICTIONS}), c AS (SELECT label AS class FROM p WHERE label IS NOT NULL UNION SELECT predicted_label FROM p WHERE predicted_label IS NOT NULL),
          s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE predicted_label = class) AS said,
            (SELECT count(*) FROM p WHERE label = class AND predicted_label = class) AS tp FROM c),
          m AS (SELECT class, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
            CASE WHEN said + support > 0 THEN 2 * tp / (said + support) ELSE 0 END AS f1, support, tp FROM s),
          a AS (SELECT class, precision, recall, f1, support FROM m
            UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""",
)
def _(spark, d):
    report = mt.classification_report(predictions(spark, d))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _scored_tags(spark, d):
    base = tags(spark, d).drop("text")
    parts = F.split("label", ", ")
    return base.withColumn("y", F.array(*[F.array_contains(parts, l).cast("double") for l in TAG_LABELS])).withColumn(
        "prob", F.array(*[unit(l) for l in TAG_LABELS])
    )


_CELLS = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{l}' AS label, CASE WHEN list_contains(string_split(label, ', '), '{l}') THEN 1.0 ELSE 0.0 END AS y, {sql_unit(l)} AS p FROM ({TAGS})"
    for l in TAG_LABELS
) + "), e AS (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM c)"


@query("element_accuracy", f"{_CELLS} SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1.0) THEN 1.0 ELSE 0.0 END), 6) AS element_accuracy, count(*) AS n_cells FROM c")
def _(spark, d):
    cells = mt.label_cells(_scored_tags(spark, d), labels=TAG_LABELS)
    return mt.element_accuracy(cells).withColumn("element_accuracy", F.round("element_accuracy", 6))


@query(
    "multilabel_log_loss",
    f"""{_CELLS}, l AS (SELECT label, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss, min(y) < max(y) AS mixed FROM e GROUP BY label)
        SELECT round(CASE WHEN bool_and(mixed) THEN avg(loss) ELSE 'NaN'::DOUBLE END, 6) AS log_loss, count(*) AS n_labels FROM l""",
)
def _(spark, d):
    cells = mt.label_cells(_scored_tags(spark, d), labels=TAG_LABELS)
    return mt.multilabel_log_loss(cells).withColumn("log_loss", F.round("log_loss", 6))


@query(
    "binary_metrics",
    f"""{_CELLS}, n AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn,
          avg(CASE WHEN (p >= 0.5) = (y = 1.0) THEN 1.0 ELSE 0.0 END) AS acc, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss FROM e)
        SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
          round(acc, 6) AS binary_accuracy, round(loss, 6) AS loss FROM n""",
)
def _(spark, d):
    row = mt.binary_metrics(mt.label_cells(_scored_tags(spark, d), labels=TAG_LABELS))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


_LINE = """'- Text: "' || substring(text, 1, 150) || '..."' || ', True: ' || label || ', Predicted: ' || coalesce(predicted_label, 'null')
 || ' (Probs: de: ' || printf('%.3f', de_prob) || ', en: ' || printf('%.3f', en_prob) || ')'"""
_SHOWN = f"SELECT *, {sql_unit('de')} AS de_prob, {sql_unit('en')} AS en_prob FROM ({PREDICTIONS})"


@query(
    "error_sample",
    f"""WITH p AS ({_SHOWN}), w AS (SELECT * FROM p WHERE label IS DISTINCT FROM predicted_label ORDER BY row_id LIMIT 10),
          r AS (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM p WHERE label = predicted_label),
          k AS (SELECT row_id, text, label, predicted_label, de_prob, en_prob, false AS is_correct FROM w UNION ALL
            SELECT row_id, text, label, predicted_label, de_prob, en_prob, true FROM r WHERE rn <= 20 - (SELECT count(*) FROM w))
        SELECT row_id, is_correct, {_LINE} AS line FROM k""",
)
def _(spark, d):
    shown = predictions(spark, d).withColumn("de_prob", unit("de")).withColumn("en_prob", unit("en"))
    return mt.error_sample(shown, LANGS)


# --- score projections -----------------------------------------------------------------------


@query(
    "score_binary",
    f"""SELECT row_id, round({sql_unit('q')}, 6) AS probability, CASE WHEN {sql_unit('q')} >= 0.5 THEN '1' ELSE '0' END AS predicted_label FROM ({DOCS})""",
)
def _(spark, d):
    scored = docs(spark, d).select("row_id", F.array(1 - unit("q"), unit("q")).alias("_p"))
    return project_scores(scored, "binary_sigmoid", ["0", "1"]).withColumn("probability", F.round("probability", 6))


@query(
    "score_multiclass",
    f"""WITH p AS (SELECT row_id, {", ".join(f"{sql_unit(l)} AS {l}" for l in LANGS)} FROM ({DOCS}))
        SELECT row_id, round(greatest(de, en, es, fr), 6) AS probability,
          CASE greatest(de, en, es, fr) WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS predicted_label FROM p""",
)
def _(spark, d):
    scored = docs(spark, d).select("row_id", F.array(*[unit(l) for l in LANGS]).alias("_p"))
    return project_scores(scored, "multiclass", LANGS).withColumn("probability", F.round("probability", 6))


_ACTIVE = lambda op: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_unit(l)} {op} 0.5 THEN '{l}' END" for l in LANGS) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "score_multilabel",
    f"SELECT row_id, {', '.join(f'round({sql_unit(l)}, 6) AS {l}_prob' for l in LANGS)}, {_ACTIVE('>=')} AS predicted_label FROM ({DOCS})",
)
def _(spark, d):
    scored = docs(spark, d).select("row_id", F.array(*[unit(l) for l in LANGS]).alias("_p"))
    out = project_scores(scored, "multilabel_sigmoid", LANGS)
    return out.select("row_id", *[F.round(f"{l}_prob", 6).alias(f"{l}_prob") for l in LANGS], "predicted_label")


@query(
    "score_struct",
    f"SELECT row_id, text, round({sql_unit('en')}, 6) AS p_en, {_ACTIVE('>')} AS predicted_labels FROM ({DOCS})",
)
def _(spark, d):
    scored = docs(spark, d).select("row_id", "text", F.array(*[unit(l) for l in LANGS]).alias("_p"))
    out = struct_scores(scored, LANGS)
    return out.select(
        "row_id", "text", F.round(F.element_at("predictions", "en"), 6).alias("p_en"),
        F.array_join("predicted_labels", ",").alias("predicted_labels"),
    )
