"""Queries over teacher requests and replies, and over multi-label synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import replies as rp
from labelmill.operators import replies as rq
from labelmill.operators import requests as rs
from labelmill.operators.synthesis import synthesise_multilabel
from labelmill.plans import generate as gen
from labelmill.plans.registry import DOCS, docs, query, sql_int, sql_key, sql_strip, table
from labelmill.session import scratch_path
from labelmill.sources.writers import log_responses, read_responses
from labelmill.streaming.ingest import stream_samples

# Replies are made from conversation texts: objects for users, numbered pairs for assistants, lines otherwise.


def _json(c):
    """JSON string literal of a text column."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def responses(spark, d):
    """``(seq, class_label, prompt_type, prompt, response, status)`` from the conversations."""
    t, role = F.col("text"), F.col("role")
    plain = F.translate(t, '"{}\\', "")
    objects = F.concat(
        F.lit('Sure: {"1": '), _json(t), F.lit(', "2": "x", "3": "short", "2": '), _json(F.concat(F.lit(' "'), t, F.lit('" '))),
        F.lit(', "4": null, "5": 12345678901} done'),
    )
    pairs = F.concat(F.lit('"1": "'), plain, F.lit('", "2": "", "3": "ends\\", "4": "ok"'))
    broken = F.concat(F.lit('{"1": "'), plain, F.lit('", oops}'))
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("seq"),
        role.alias("class_label"),
        F.lit("training_data").alias("prompt_type"),
        F.substring("text", 1, 40).alias("prompt"),
        F.when(F.col("turn") == 7, broken).when(role == "user", objects).when(role == "assistant", pairs)
        .otherwise(F.concat(plain, F.lit("\n\n  "), plain)).alias("response"),
        F.when(F.col("turn") == 5, "failed").when(F.col("turn") == 6, "failed_empty").otherwise("success").alias("status"),
    )


_PLAIN = """translate(text, '"{}\\', '')"""
RESPONSES = f"""SELECT conv_id * 1000 + turn + 1 AS seq, role AS class_label, 'training_data' AS prompt_type,
  CASE WHEN turn = 7 THEN '{{"1": "' || {_PLAIN} || '", oops}}'
    WHEN role = 'user' THEN 'Sure: {{"1": ' || CAST(to_json(text) AS VARCHAR) || ', "2": "x", "3": "short", "2": ' || CAST(to_json(' "' || text || '" ') AS VARCHAR) || ', "4": null, "5": 12345678901}} done'
    WHEN role = 'assistant' THEN '"1": "' || {_PLAIN} || '", "2": "", "3": "ends\\", "4": "ok"'
    ELSE {_PLAIN} || chr(10) || chr(10) || '  ' || {_PLAIN} END AS response,
  CASE WHEN turn = 5 THEN 'failed' WHEN turn = 6 THEN 'failed_empty' ELSE 'success' END AS status FROM conversations"""

SAMPLES = rf"""r AS (SELECT * FROM ({RESPONSES}) WHERE status = 'success'),
  o AS (SELECT *, regexp_extract(response, '(?s)\{{.*\}}') AS span FROM r WHERE contains(response, '{{') AND contains(response, '}}')),
  e AS (SELECT seq, class_label, j.key, j.value ->> '$' AS v, row_number() OVER (PARTITION BY seq ORDER BY j.id) AS nth
        FROM (SELECT * FROM o WHERE json_valid(span)) o, json_each(o.span) j),
  ek AS (SELECT seq, class_label, nth, trim({sql_strip('v')}, '"') AS text FROM (SELECT *, max(nth) OVER (PARTITION BY seq, key) AS m FROM e) WHERE nth = m),
  f AS (SELECT *, regexp_extract_all(response, '"(\d+)"\s*:\s*"([^"]*)"', 2) AS pairs FROM r WHERE NOT (contains(response, '{{') AND contains(response, '}}'))),
  p AS (SELECT seq, class_label, unnest(pairs) AS text FROM f WHERE len(pairs) > 0),
  l AS (SELECT seq, class_label, {sql_strip("trim(" + sql_strip("line") + ", '\"')")} AS text FROM
        (SELECT seq, class_label, unnest(string_split({sql_strip('response')}, chr(10))) AS line FROM f WHERE len(pairs) = 0)),
  samples AS (SELECT seq, class_label, text FROM ek WHERE length(text) >= 10
    UNION ALL SELECT seq, class_label, text FROM p WHERE text <> '' AND NOT ends_with(text, '\')
    UNION ALL SELECT seq, class_label, text FROM l WHERE length(text) >= 10 AND NOT starts_with(text, '{{') AND NOT ends_with(text, '}}'))"""


@query("parse_samples", f"WITH {SAMPLES} SELECT seq, class_label, text FROM samples")
def _(spark, d):
    return rq.parse_samples(responses(spark, d)).select("seq", "class_label", "text")


_FENCED = """CASE role WHEN 'user' THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"a":"' || text || '"}' || chr(10) || '``` bye ```x```'
  WHEN 'assistant' THEN '```' || chr(10) || text || '```' ELSE ' ' || text || ' ' END"""


def _fenced(spark, d):
    made = F.expr(_FENCED.replace("chr(10)", "'\\n'"))
    return table(spark, d, "conversations").select("conv_id", "turn", made.alias("reply"))


@query(
    "strip_fence",
    f"""WITH a AS (SELECT conv_id, turn, {_FENCED} AS s FROM conversations),
          b AS (SELECT conv_id, turn, CASE WHEN contains(s, '```json') THEN substring(s, strpos(s, '```json') + 7) ELSE s END AS s FROM a)
        SELECT conv_id, turn, {sql_strip("CASE WHEN contains(s, '```') THEN substring(s, 1, strpos(s, '```') - 1) ELSE s END")} AS body FROM b""",
)
def _(spark, d):
    return _fenced(spark, d).select("conv_id", "turn", rp.strip_fence(F.col("reply")).alias("body"))


@query(
    "json_span",
    rf"SELECT conv_id, turn, regexp_extract(s, '(?s)\{{.*\}}') AS span FROM (SELECT conv_id, turn, {_FENCED} AS s FROM conversations)",
)
def _(spark, d):
    return _fenced(spark, d).select("conv_id", "turn", rp.json_span(F.col("reply")).alias("span"))


# --- configurations: one reply per document source, some of them broken on purpose -------------


def _source_labels(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("volume")
    )


def config_replies(spark, d):
    base = _source_labels(spark, d)
    one = lambda l: F.concat(F.lit('"'), l, F.lit('": "Write in '), l, F.lit('"'))
    names = F.concat(F.lit('["'), F.array_join(F.reverse("langs"), '", "'), F.lit('"]'))
    prompts = F.concat(F.lit("{"), F.array_join(F.transform("langs", one), ", "), F.lit("}"))
    src = F.col("source")
    body = F.concat(
        F.lit('{"summary": "Languages of '), src, F.lit('", "classification_type": "multiclass_softmax", "class_labels": '),
        F.when(src == "src13", "[]").when(src == "src11", '["en", "en"]').otherwise(names),
        F.lit(', "prompts": '), F.when(src == "src5", '{"xx": "y"}').when(src == "src11", '{"en": "y"}').otherwise(prompts),
        F.when(src == "src3", "").otherwise(', "model_prefix": "langs"'),
        F.lit(', "training_data_volume": '), F.col("volume").cast("string"), F.lit("}"),
    )
    reply = (
        F.when(src == "src9", F.lit("I cannot do that"))
        .when(src == "src7", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nEnjoy")))
        .otherwise(body)
    )
    return base.select("source", reply.alias("response"))


CONFIG_REPLIES = """SELECT source, CASE WHEN source = 'src9' THEN 'I cannot do that' WHEN source = 'src7' THEN 'Here it is:' || chr(10) || '```json' || body || '```' ELSE body END AS response
  FROM (SELECT source, '{"summary": "Languages of ' || source || '", "classification_type": "multiclass_softmax", "class_labels": '
    || CASE WHEN source = 'src13' THEN '[]' WHEN source = 'src11' THEN '["en", "en"]' ELSE '["' || array_to_string(list_reverse(langs), '", "') || '"]' END
    || ', "prompts": ' || CASE WHEN source = 'src5' THEN '{"xx": "y"}' WHEN source = 'src11' THEN '{"en": "y"}'
       ELSE '{' || array_to_string(list_transform(langs, lambda l: '"' || l || '": "Write in ' || l || '"'), ', ') || '}' END
    || CASE WHEN source = 'src3' THEN '' ELSE ', "model_prefix": "langs"' END || ', "training_data_volume": ' || volume || '}' AS body
   FROM (SELECT source, list_sort(list(DISTINCT lang)) AS langs, count(*) AS volume FROM documents GROUP BY source))"""


@query(
    "parse_config",
    f"""WITH r AS (SELECT source, CASE WHEN contains(response, '```json') THEN split_part(split_part(response, '```json', 2), '```', 1) ELSE response END AS b FROM ({CONFIG_REPLIES})),
          j AS (SELECT source, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM r),
          k AS (SELECT source, j, json_keys(j) AS ks, CAST(j -> '$.class_labels' AS VARCHAR[]) AS labels, json_keys(j, '$.prompts') AS ps FROM j),
          e AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid_json'
             WHEN NOT list_has_all(ks, ['summary', 'classification_type', 'class_labels', 'prompts', 'model_prefix', 'training_data_volume']) THEN 'missing_keys'
             WHEN coalesce(len(labels), 0) = 0 THEN 'no_class_labels'
             ELSE array_to_string(list_filter([CASE WHEN NOT (list_has_all(labels, ps) AND list_has_all(ps, labels)) THEN 'prompt_keys_differ' END,
               CASE WHEN len(list_distinct(labels)) < 2 THEN 'fewer_than_two_labels' END], lambda x: x IS NOT NULL), ',') END AS errors FROM k)
        SELECT source, errors, j ->> '$.classification_type' AS classification_type, array_to_string(list_sort(list_distinct(labels)), ',') AS labels,
          CAST(j ->> '$.training_data_volume' AS BIGINT) AS volume FROM e""",
)
def _(spark, d):
    parsed = rq.parse_config(config_replies(spark, d))
    return parsed.select(
        "source",
        F.array_join("errors", ",").alias("errors"),
        F.col("config.classification_type").alias("classification_type"),
        F.array_join("config.class_labels", ",").alias("labels"),
        F.col("config.training_data_volume").alias("volume"),
    )


def _refinement(spark, d):
    base = _source_labels(spark, d)
    src = F.col("source")
    old = F.map_from_arrays("langs", F.transform("langs", lambda l: F.concat(F.lit("Write in "), l)))
    new = lambda l: F.concat(F.lit('"'), l, F.lit('": "'), F.when(l == "en", "Write plain English").otherwise(F.concat(F.lit("Write in "), l)), F.lit('"'))
    prompts = F.when(src == "src4", F.lit('{"zz": "none"}')).otherwise(
        F.concat(F.lit("{"), F.array_join(F.transform("langs", new), ", "), F.lit("}"))
    )
    reply = F.concat(
        F.lit("```json\n{"), F.when(src == "src2", "").otherwise('"evaluation_summary": "fine", '),
        F.lit('"refined_prompts": '), prompts, F.lit("}\n```"),
    )
    configs = base.select(src.alias("config_id"), old.alias("prompts"))
    return configs, base.select(src.alias("config_id"), F.when(src == "src6", "no answer").otherwise(reply).alias("response"))


_REFINED = """WITH s AS (SELECT DISTINCT source AS config_id, lang AS class_label FROM documents),
  r AS (SELECT *, config_id NOT IN ('src2', 'src4', 'src6') AS accepted, 'Write in ' || class_label AS previous_prompt FROM s),
  q AS (SELECT *, CASE WHEN accepted AND class_label = 'en' THEN 'Write plain English' ELSE previous_prompt END AS prompt FROM r)"""


@query(
    "apply_refinement",
    f"{_REFINED} SELECT config_id, class_label, previous_prompt, prompt, prompt <> previous_prompt AS changed, accepted, CASE WHEN accepted THEN 'fine' END AS evaluation FROM q",
)
def _(spark, d):
    return rq.apply_refinement(*_refinement(spark, d))


@query(
    "refinement_history",
    f"""{_REFINED} SELECT config_id, CAST(1 AS INTEGER) AS cycle, max(CASE WHEN accepted THEN 'fine' END) AS evaluation,
        count(*) AS n_prompts, string_agg(prompt, '|' ORDER BY class_label) AS refined FROM q GROUP BY config_id""",
)
def _(spark, d):
    history = rq.refinement_history(rq.apply_refinement(*_refinement(spark, d)), 1)
    entries = F.array_sort(F.map_entries("refined_prompts"))
    return history.select(
        "config_id", "cycle", "evaluation",
        F.size("previous_prompts").cast("bigint").alias("n_prompts"),
        F.array_join(F.transform(entries, lambda e: e["value"]), "|").alias("refined"),
    )


# --- label assignment -------------------------------------------------------------------------

_ASSIGNED = """CASE WHEN source = 'src2' THEN '["zz"]' WHEN source = 'src4' THEN '["en", "fr", "nope", "en"]' ELSE '["' || lang || '"]' END"""


@query(
    "apply_assignments",
    """WITH b AS (SELECT doc_id AS row_id, text, lang, source, doc_id // 15 AS batch FROM documents),
         v AS (SELECT batch, max(length(text)) > 6000 AS silent FROM b GROUP BY batch)
       SELECT row_id, text, CASE WHEN silent OR source NOT IN ('src4') THEN lang ELSE 'en,fr,en' END AS label
       FROM b JOIN v USING (batch) WHERE silent OR source <> 'src1'""",
)
def _(spark, d):
    base = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"), "source")
    rows = rq.labelling_batches(base)
    entry = F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('": '), F.expr(_ASSIGNED.replace("lang", "label")))
    # A batch has 15 rows at most.
    answers = rows.groupBy("batch").agg(
        F.array_join(F.collect_list(F.when(F.col("source") != "src1", entry)), ", ").alias("body"),
        (F.max(F.length("text")) > 6000).alias("silent"),
    )
    replies = answers.select(
        "batch", F.when(F.col("silent"), "No idea.").otherwise(F.concat(F.lit('Result: {"99": ["en"], "x": ["en"], '), "body", F.lit("}"))).alias("response")
    )
    return rq.apply_assignments(rows.drop("source"), replies, docs(spark, d).select("label").distinct())


# --- requests, quotas and counters --------------------------------------------------------------


def classes(spark, d):
    """One class per language, Spanish without a prompt."""
    names = table(spark, d, "documents").select(F.col("lang").alias("class_label")).distinct()
    return names.withColumn("prompt", F.when(F.col("class_label") != "es", F.concat(F.lit("Write in "), F.col("class_label"))))


@query(
    "plan_requests",
    """WITH t AS (SELECT greatest(2500, count(*) // 4) AS target FROM documents), n AS (SELECT CAST(greatest(1, round_even(target / 50, 0)) AS BIGINT) AS n FROM t),
         c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS ord FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'es')),
         p AS (SELECT ord * n + i AS seq, lang AS class_label, 'training_data' AS prompt_type, 'Write in ' || lang AS prompt
               FROM (SELECT c.*, n, unnest(range(1, n + 1)) AS i FROM c, n))
       SELECT seq, class_label, prompt_type, prompt, (seq - 1) // 10 AS batch FROM p""",
)
def _(spark, d):
    base = table(spark, d, "documents")
    target = rs.target_per_class(base.count(), 4)
    return rs.with_batches(rs.plan_requests(classes(spark, d), target))


@query(
    "plan_edge_requests",
    """WITH c AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS ord FROM (SELECT DISTINCT role FROM conversations))
       SELECT ord * 2 + i AS seq, role AS class_label, 'edge_case' AS prompt_type, role AS prompt, (ord * 2 + i - 1) // 5 AS batch
       FROM (SELECT *, unnest(range(1, 3)) AS i FROM c)""",
)
def _(spark, d):
    roles = table(spark, d, "conversations").select(F.col("role").alias("class_label"), F.col("role").alias("prompt")).distinct()
    return rs.with_batches(rs.plan_requests(roles, 100, rs.ROWS_PER_EDGE_REQUEST, "edge_case"), 5)


@query("classes_without_prompt", "SELECT DISTINCT lang AS class_label FROM documents WHERE lang = 'es'")
def _(spark, d):
    return rs.classes_without_prompt(classes(spark, d))


# Documents stand for samples: batch = document id // 10, class = language, target = a tenth of the documents.
@query(
    "apply_quota",
    """WITH s AS (SELECT doc_id, lang, doc_id // 10 AS batch FROM documents WHERE lang IN ('en', 'fr')),
         t AS (SELECT count(*) // 10 AS target FROM documents),
         r AS (SELECT lang, batch, sum(count(*)) OVER (PARTITION BY lang ORDER BY batch) AS total FROM s GROUP BY lang, batch),
         h AS (SELECT lang, min(batch) AS b FROM r, t WHERE total >= target GROUP BY lang),
         x AS (SELECT CASE WHEN count(*) = 2 THEN max(b) END AS stop FROM h)
       SELECT doc_id, lang AS class_label, batch FROM s, x WHERE stop IS NULL OR batch <= stop""",
)
def _(spark, d):
    base = table(spark, d, "documents")
    samples = base.filter(F.col("lang").isin("en", "fr")).select(
        "doc_id", F.col("lang").alias("class_label"), F.floor(F.col("doc_id") / 10).alias("batch")
    )
    return rs.apply_quota(samples, samples.select("class_label").distinct(), base.count() // 10)


@query(
    "generation_stats",
    f"""WITH {SAMPLES}, q AS (SELECT *, (seq - 1) // 100000 AS batch FROM ({RESPONSES})),
          a AS (SELECT class_label, batch, count(*) AS requests, count(*) FILTER (status <> 'success') AS failed FROM q GROUP BY ALL),
          n AS (SELECT class_label, (seq - 1) // 100000 AS batch, count(*) AS samples FROM samples GROUP BY ALL)
        SELECT class_label, batch, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(failed) AS BIGINT) AS failed, CAST(coalesce(sum(samples), 0) AS BIGINT) AS samples
        FROM a LEFT JOIN n USING (class_label, batch) GROUP BY ROLLUP (class_label, batch)""",
)
def _(spark, d):
    results = rs.with_batches(responses(spark, d), 100_000)
    return rs.generation_stats(results, rq.parse_samples(results))


@query(
    "preview_by_class",
    f"""WITH l AS (SELECT seq, class_label, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM
           (SELECT seq, class_label, string_split(response, chr(10)) AS parts FROM ({RESPONSES}) WHERE status = 'success')),
         s AS (SELECT seq, class_label, pos, {sql_strip('line')} AS line FROM l),
         k AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY seq, pos) AS rn FROM s WHERE line <> ''),
         b AS (SELECT class_label, string_agg('  - ' || substring(line, 1, 100) || '...', chr(10) ORDER BY rn) AS body FROM k WHERE rn <= 3 GROUP BY class_label)
       SELECT c.class_label, '* Samples for Class ''' || c.class_label || ''':' || coalesce(chr(10) || body, ' No samples generated.') AS preview
       FROM (SELECT DISTINCT role AS class_label FROM conversations UNION SELECT DISTINCT lang FROM documents) c LEFT JOIN b USING (class_label)""",
)
def _(spark, d):
    found = responses(spark, d)
    names = found.select("class_label").unionByName(classes(spark, d).select("class_label"))
    return rq.preview_by_class(found, names)


# --- synthesis ----------------------------------------------------------------------------------


def _draws_sql(k: int, share: str) -> str:
    return f"""d{k} AS (SELECT i, list_slice(list_sort(list_transform(ls, lambda l: md5('42:{k}:' || i || ':' || l) || l)), 1, {k}) AS picked
        FROM (SELECT unnest(range(0, CAST(floor(n * {share}) AS BIGINT))) AS i, ls FROM n, names)),
      e{k} AS (SELECT i, pos, substring(picked[pos], 33) AS label FROM (SELECT i, picked, unnest(range(1, {k + 1})) AS pos FROM d{k})),
      w{k} AS (SELECT e.i, e.pos, e.label, {sql_int(f"'42:text:{k}:' || i || ':' || (pos - 1)")} % size AS idx FROM e{k} e JOIN sizes USING (label)),
      m{k} AS (SELECT i, string_agg(text, ' ' ORDER BY pos) AS text, string_agg(label, ',' ORDER BY pos) AS label FROM w{k} JOIN src USING (label, idx) GROUP BY i
        HAVING count(*) = {k})"""


def synthesis_sql(base: str, names: str = "SELECT label FROM base", most: int = 3) -> str:
    """CTEs up to ``made``: the synthetic rows ``(kind, seq, text, label)`` of a table ``(row_id, text, label)``."""
    shares = {2: "0.3", 3: "0.2"}
    parts = ["SELECT 1 AS kind, row_id AS seq, text, label FROM src WHERE rn <= (SELECT floor(n * 0.5) FROM n)", "SELECT 2, i, text, label FROM m2"]
    parts += ["SELECT 3, i, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END, label FROM m3"]
    return f"""base AS ({base}), n AS (SELECT count(*) AS n FROM base), names AS (SELECT list(DISTINCT label ORDER BY label) AS ls FROM ({names})),
      sizes AS (SELECT label, count(*) AS size FROM base GROUP BY label),
      src AS (SELECT row_id, trim({sql_strip('text')}, '"') AS text, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key()}, row_id) - 1 AS idx,
              row_number() OVER (ORDER BY {sql_key()}, row_id) AS rn FROM base),
      {", ".join(_draws_sql(k, shares[k]) for k in range(2, most + 1))}, made AS ({" UNION ALL ".join(parts[:most])})"""


@query("synthesise_multilabel", f"WITH {synthesis_sql(DOCS)} SELECT * FROM made")
def _(spark, d):
    return synthesise_multilabel(docs(spark, d))


# --- teacher runs with a deterministic stand-in: it echoes the prompt, so results follow from the tables --------


def stand_in():
    """Teacher with five samples per request; every seventh request raises, every eleventh comes back empty.

    Made inside a function, so that it travels to the executors by value.
    """

    def answer(seq, prompt):
        if seq % 7 == 0:
            raise ValueError("no answer")
        return "" if seq % 11 == 0 else "\n".join(f"{prompt}, request {seq}, text {k}" for k in range(5))

    return rs.one_by_one(answer)


def _prompts(spark, d):
    """A request per document: the prompt is the text, the class the language."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") + 1).alias("seq"), F.col("lang").alias("class_label"), F.lit("training_data").alias("prompt_type"),
        F.col("text").alias("prompt"),
    )


@query(
    "teacher_map",
    """SELECT doc_id + 1 AS seq, doc_id // 10 AS batch, lang AS class_label, CASE WHEN (doc_id + 1) % 7 = 0 THEN 'failed'
         WHEN (doc_id + 1) % 11 = 0 THEN 'failed_empty' ELSE 'success' END AS status,
         CASE WHEN (doc_id + 1) % 7 <> 0 AND (doc_id + 1) % 11 <> 0 THEN list_reduce(list_transform(range(0, 5),
           lambda k: text || ', request ' || (doc_id + 1) || ', text ' || k), lambda a, b: a || chr(10) || b) END AS response,
         CASE WHEN (doc_id + 1) % 7 = 0 THEN 'ValueError: no answer' WHEN (doc_id + 1) % 11 = 0 THEN 'empty response' END AS error FROM documents""",
)
def _(spark, d):
    return rs.teacher_map(_prompts(spark, d), stand_in()).select("seq", "batch", "class_label", "status", "response", "error")


@query(
    "log_responses",
    """SELECT doc_id + 1 AS seq, lang AS class_label, CASE WHEN (doc_id + 1) % 7 = 0 THEN 'failed'
         WHEN (doc_id + 1) % 11 = 0 THEN 'failed_empty' ELSE 'success' END AS status, 'stand-in' AS model_used, true AS has_time FROM documents""",
)
def _(spark, d):
    path = scratch_path(spark, "responses")
    log_responses(rs.teacher_map(_prompts(spark, d), stand_in()), path, "stand-in")
    return read_responses(spark, path).select(
        "seq", "class_label", "status", "model_used", F.col("logged_at").isNotNull().alias("has_time")
    )


def _source_classes(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("class_label")).agg(
        F.concat(F.lit("Write like "), F.col("class_label"), F.lit(" about "), F.max("n_chars").cast("string")).alias("prompt")
    )


# The requests of twenty classes and the samples of those that are answered: (label, text, seq, k).
_ANSWERED = """WITH c AS (SELECT source, 'Write like ' || source || ' about ' || max(n_chars) AS prompt, row_number() OVER (ORDER BY source) - 1 AS ord FROM documents GROUP BY source),
         t AS (SELECT greatest(100, count(*) // (SELECT count(*) FROM c)) AS target FROM documents),
         r AS (SELECT source, prompt, ord * n + i AS seq FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c, (SELECT CAST(greatest(1, round_even(target / 50, 0)) AS BIGINT) AS n FROM t)))
       SELECT source AS label, prompt || ', request ' || seq || ', text ' || k AS text, seq, k FROM (SELECT *, unnest(range(0, 5)) AS k FROM r WHERE seq % 7 <> 0 AND seq % 11 <> 0)"""


@query("generate_training", f"SELECT label, text FROM ({_ANSWERED})")
def _(spark, d):
    rows = table(spark, d, "documents").count()
    made = gen.generate_training(_source_classes(spark, d), stand_in(), volume=rows, min_per_class=100)
    return made.samples.select("label", "text")


@query(
    "generate_edge_cases",
    """WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS ord FROM documents GROUP BY source),
         r AS (SELECT source, ord * 2 + i AS seq, (ord * 2 + i - 1) // 5 AS batch FROM (SELECT *, unnest([1, 2]) AS i FROM c)),
         k AS (SELECT source AS class_label, batch, seq % 7 <> 0 AND seq % 11 <> 0 AS ok FROM r)
       SELECT class_label, batch, count(*) AS requests, count(*) FILTER (NOT ok) AS failed, CAST(sum(CASE WHEN ok THEN 5 ELSE 0 END) AS BIGINT) AS samples,
         true AS skipped_second_time FROM k GROUP BY ROLLUP (class_label, batch)""",
)
def _(spark, d):
    out = scratch_path(spark, "edge")
    made = gen.generate_edge_cases(
        _source_classes(spark, d), stand_in(), "Tell the source of a text", "multiclass_softmax", 80, out=out
    )
    again = gen.generate_edge_cases(_source_classes(spark, d), stand_in(), "", "", out=out)
    return made.stats.withColumn("skipped_second_time", F.lit(again is None))


@query(
    "generate_multilabel",
    f"""WITH {synthesis_sql(f"SELECT seq * 1048576 + k AS row_id, text, label FROM ({_ANSWERED})", "SELECT source AS label FROM documents")} SELECT * FROM made""",
)
def _(spark, d):
    rows = table(spark, d, "documents").count()
    return gen.generate_multilabel(_source_classes(spark, d), stand_in(), volume=rows, min_per_class=100)


@query("stream_samples", f"WITH {SAMPLES} SELECT seq, class_label AS label, text FROM samples")
def _(spark, d):
    arriving, out = scratch_path(spark, "arriving"), scratch_path(spark, "samples")
    found = responses(spark, d).drop("prompt")
    found.write.json(arriving)
    stream_samples(spark, arriving, out, scratch_path(spark, "checkpoint"), files_per_trigger=100).awaitTermination()
    return spark.read.schema("seq bigint, pos int, text string, label string").parquet(out).select("seq", "label", "text")
