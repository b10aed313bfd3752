"""Queries over text functions, label functions and label standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import prompts, text as tx
from labelmill.operators import labels as lb
from labelmill.plans.registry import (
    DOCS, PREDICTIONS, TAG_LABELS, TAGS, WS, docs, predictions, query, sql_strip, table, tags,
)

_CLEAN = f"""trim(replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'), '""', '"'))"""


@query("clean_text", f"SELECT doc_id AS row_id, {_CLEAN} AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("row_id", tx.clean_text(F.col("text")).alias("text"))


@query("unquote", f"""SELECT doc_id AS row_id, trim({sql_strip("' ""' || text || '"" '")}, '"') AS text FROM documents""")
def _(spark, d):
    quoted = F.concat(F.lit(' ""'), F.col("text"), F.lit('"" '))
    return docs(spark, d).select("row_id", tx.unquote(quoted).alias("text"))


@query("norm_key", f"SELECT doc_id AS row_id, lower({sql_strip('text')}) AS norm_key FROM documents")
def _(spark, d):
    return docs(spark, d).select("row_id", tx.norm_key(F.col("text")).alias("norm_key"))


@query(
    "ellipsis",
    """SELECT doc_id AS row_id,
       CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS cut,
       substring(text, 1, 150) || '...' AS snippet, substring(text, 1, 200) AS head FROM documents""",
)
def _(spark, d):
    t = F.col("text")
    return docs(spark, d).select(
        "row_id", tx.ellipsis(t, 100).alias("cut"), tx.ellipsis(t, 150, "always").alias("snippet"),
        tx.ellipsis(t, 200, "never").alias("head"),
    )


@query(
    "slug",
    rf"""WITH w AS (SELECT conv_id, turn, array_to_string(list_filter(
             regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
             lambda x: x NOT IN ({", ".join(f"'{s}'" for s in tx.SLUG_STOP_WORDS)})), '') AS t FROM conversations),
         k AS (SELECT conv_id, turn, regexp_replace(t, '[^\p{{L}}\p{{N}}_' || '{WS[1:-1]}' || ']', '', 'g') AS t FROM w),
         j AS (SELECT conv_id, turn, regexp_replace(regexp_replace({sql_strip('t')}, '{WS}+', '_', 'g'), '_+', '_', 'g') AS t FROM k)
       SELECT conv_id, turn, coalesce(nullif(substring(trim(t, '_'), 1, 30), ''), 'user_dataset') AS slug FROM j""",
)
def _(spark, d):
    # Language words of the task vocabulary are mixed in by the texts themselves ("the", "of", "for").
    return table(spark, d, "conversations").select("conv_id", "turn", tx.slug(F.col("text")).alias("slug"))


_PROBLEM = "Find the language of a text"


@query(
    "render_prompts",
    f"""WITH c AS (SELECT DISTINCT lang, source FROM documents),
            n AS (SELECT string_agg(lang, ', ' ORDER BY lang) AS classes FROM (SELECT DISTINCT lang FROM documents))
        SELECT lang, source, replace(replace(replace(replace(replace('{prompts.EDGE_TEMPLATE}',
          '{{class_label}}', lang), '{{classification_type}}', 'multiclass'), '{{problem}}', '{_PROBLEM}'),
          '{{classes}}', (SELECT classes FROM n)), '{{language}}', source) AS prompt FROM c""",
)
def _(spark, d):
    pairs = table(spark, d, "documents").select("lang", "source").distinct()
    names = pairs.agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ")).scalar()
    return pairs.select(
        "lang", "source",
        prompts.render(
            prompts.EDGE_TEMPLATE, class_label=F.col("lang"), classification_type=F.lit("multiclass"),
            problem=F.lit(_PROBLEM), classes=names, language=F.col("source"),
        ).alias("prompt"),
    )


@query(
    "system_prompt",
    f"""WITH c AS (SELECT DISTINCT lang, source,
             CASE WHEN lang = 'fr' THEN 'multilabel' WHEN lang = 'de' THEN 'binary' ELSE 'multiclass' END AS task,
             CASE WHEN source < 'src15' THEN 'auto' WHEN source < 'src3' THEN 'sigmoid' ELSE 'softmax' END AS pref
             FROM documents)
        SELECT lang, source, replace(CASE WHEN task = 'multilabel' OR pref = 'sigmoid' THEN '{prompts.MULTI_SYSTEM}'
             ELSE '{prompts.SINGLE_SYSTEM}' END, '{{language}}', lang) AS prompt,
             CASE pref WHEN 'sigmoid' THEN '{prompts.ACTIVATION_NOTES["sigmoid"]}'
             WHEN 'softmax' THEN '{prompts.ACTIVATION_NOTES["softmax"]}' ELSE '{prompts.ACTIVATION_NOTES["auto"]}' END AS note
        FROM c""",
)
def _(spark, d):
    task = F.when(F.col("lang") == "fr", "multilabel").when(F.col("lang") == "de", "binary").otherwise("multiclass")
    pref = F.when(F.col("source") < "src15", "auto").when(F.col("source") < "src3", "sigmoid").otherwise("softmax")
    pairs = table(spark, d, "documents").select("lang", "source").distinct()
    return pairs.select(
        "lang", "source",
        prompts.system_prompt(task, F.col("lang"), pref).alias("prompt"),
        prompts.activation_note(pref).alias("note"),
    )


@query("is_correct", f"SELECT row_id, coalesce(label = predicted_label, false) AS is_correct FROM ({PREDICTIONS})")
def _(spark, d):
    return predictions(spark, d).select(
        "row_id", tx.is_correct(F.col("label"), F.col("predicted_label")).alias("is_correct")
    )


@query(
    "to_binary",
    f"""WITH f AS (SELECT label, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM ({DOCS}) GROUP BY label)
        SELECT row_id, text, CAST(CASE WHEN code < 2 THEN code ELSE 0 END AS INTEGER) AS label
        FROM ({DOCS}) JOIN f USING (label)""",
)
def _(spark, d):
    return lb.to_binary(docs(spark, d))


@query(
    "to_binary_sorted",
    """SELECT event_id AS row_id, props AS text,
        CAST(CASE WHEN event_type = (SELECT min(event_type) FROM events WHERE event_type > (SELECT min(event_type) FROM events))
             THEN 1 ELSE 0 END AS INTEGER) AS label FROM events""",
)
def _(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_id", "row_id")
    return lb.to_binary(events, "props", "event_type", "sorted")


@query("to_multiclass", "SELECT event_id AS row_id, props AS text, CAST(user_id AS VARCHAR) AS label FROM events")
def _(spark, d):
    return lb.to_multiclass(table(spark, d, "events").withColumnRenamed("event_id", "row_id"), "props", "user_id")


_PARTS = f"list_filter(list_transform(string_split(label, ','), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@query(
    "to_multilabel",
    f"SELECT row_id, text, label, "
    + ", ".join(f"CAST(list_contains({_PARTS}, '{x}') AS INTEGER) AS label_{x}" for x in TAG_LABELS)
    + f" FROM ({TAGS})",
)
def _(spark, d):
    return lb.to_multilabel(tags(spark, d))


@query("long_labels", f"SELECT row_id, unnest(list_distinct({_PARTS})) AS label FROM ({TAGS})")
def _(spark, d):
    return lb.long_labels(tags(spark, d))


@query("to_single_label", f"SELECT row_id, string_split(label, ',')[1] AS label FROM ({TAGS})")
def _(spark, d):
    return lb.to_single_label(tags(spark, d)).select("row_id", "label")


@query(
    "multi_hot",
    f"SELECT row_id, array_to_string([" + ", ".join(f"CAST(CAST(list_contains({_PARTS}, '{x}') AS INTEGER) AS VARCHAR)" for x in TAG_LABELS)
    + f"], '') AS y FROM ({TAGS})",
)
def _(spark, d):
    hot = lb.multi_hot(tags(spark, d), TAG_LABELS)
    return hot.select("row_id", F.array_join(F.transform("y", lambda v: v.cast("int").cast("string")), "").alias("y"))


_HOLES = "SELECT doc_id AS row_id, CASE WHEN source = 'src3' THEN chr(10) || ' ' ELSE text END AS text, nullif(lang, 'es') AS label FROM documents"


@query(
    "drop_empty",
    f"SELECT row_id, text, label FROM (SELECT row_id, {_CLEAN} AS text, label FROM ({_HOLES})) WHERE label IS NOT NULL AND length(text) > 0",
)
def _(spark, d):
    holes = table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"),
        tx.clean_text(F.when(F.col("source") == "src3", "\n ").otherwise(F.col("text"))).alias("text"),
        F.nullif("lang", F.lit("es")).alias("label"),
    )
    return lb.drop_empty(holes, cleaned=True)


@query("filter_labels", f"SELECT * FROM ({DOCS}) WHERE label IN ('en', 'de')")
def _(spark, d):
    return lb.filter_labels(docs(spark, d), ["en", "de"])


@query(
    "filter_labels_by_table",
    f"SELECT * FROM ({DOCS}) WHERE label IN (SELECT lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1)",
)
def _(spark, d):
    toxic = spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1")
    allowed = table(spark, d, "documents").join(toxic, "doc_id").select("lang").distinct()
    return lb.filter_labels(docs(spark, d), allowed)


@query(
    "filter_lines",
    """WITH l AS (SELECT doc_id AS row_id, unnest(string_split(text, chr(10))) AS line FROM documents)
       SELECT row_id, line, NOT starts_with(line, '{') AND NOT ends_with(line, '}') AS is_plain
       FROM l WHERE length(line) >= 10""",
)
def _(spark, d):
    lines = docs(spark, d).select("row_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(tx.long_enough(F.col("line"))).select(
        "row_id", "line", tx.plain_line(F.col("line")).alias("is_plain")
    )


@query(
    "label_coverage",
    f"""WITH c AS (SELECT DISTINCT lang AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
                   WHERE toxic = 1 UNION SELECT 'pt'),
             s AS (SELECT DISTINCT label FROM ({DOCS}))
        SELECT coalesce(c.label, s.label) AS label, c.label IS NOT NULL AS configured, s.label IS NOT NULL AS seen
        FROM c FULL JOIN s ON c.label = s.label""",
)
def _(spark, d):
    toxic = spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1")
    base = table(spark, d, "documents")
    extra = base.limit(1).select(F.lit("pt").alias("label"))
    configured = base.join(toxic, "doc_id").select(F.col("lang").alias("label")).unionByName(extra)
    return lb.label_coverage(docs(spark, d), configured)


@query(
    "encode_labels",
    f"""WITH i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM ({DOCS})))
        SELECT row_id, CAST(idx AS INTEGER) AS idx, label AS decoded FROM ({DOCS}) JOIN i USING (label)""",
)
def _(spark, d):
    index, train, _ = lb.encode_labels(docs(spark, d))
    return lb.decode_labels(train, index, "idx", "decoded").select("row_id", "idx", "decoded")


@query(
    "unseen_labels",
    "SELECT DISTINCT event_type AS label FROM events WHERE event_type NOT IN (SELECT role FROM conversations)",
)
def _(spark, d):
    index = lb.label_index(table(spark, d, "conversations"), "role")
    return lb.unseen_labels(index, table(spark, d, "events"), "event_type")
