"""Teacher replies as tables: samples, configurations, refinements and label assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.replies import json_span, last_entries, one_json_value, parse_object, sample_texts, strip_fence
from labelmill.functions.text import ellipsis, strip
from labelmill.operators.requests import LABELLING_BATCH_SIZE, block

# Keys that a configuration reply and a refinement reply must have.
CONFIG_KEYS = ("summary", "classification_type", "class_labels", "prompts", "model_prefix", "training_data_volume")
REFINEMENT_KEYS = ("evaluation_summary", "refined_prompts")

_CONFIG_SCHEMA = (
    "summary string, classification_type string, class_labels array<string>, prompts map<string,string>, "
    "model_prefix string, training_data_volume bigint"
)
_REFINEMENT_SCHEMA = "evaluation_summary string, refined_prompts map<string,string>"


def parse_samples(results: DataFrame, response: str = "response", min_length: int = 10) -> DataFrame:
    """One row per sample found in the successful responses: the request's columns, ``pos`` and ``text``."""
    good = results.filter(F.col("status") == "success") if "status" in results.columns else results
    kept = [c for c in good.columns if c not in (response, "status", "prompt")]
    found = good.select(*kept, F.posexplode_outer(sample_texts(F.col(response), min_length)).alias("pos", "text"))
    return found.filter(F.col("text").isNotNull())


def parse_config(replies: DataFrame, response: str = "response") -> DataFrame:
    """Parse and check configuration replies; ``errors`` lists what is wrong, labels come back sorted."""
    body = strip_fence(F.col(response))
    usable = replies.withColumn("_body", body).withColumn("_ok", one_json_value(F.col("_body")))
    parsed = usable.withColumn("_keys", F.when(F.col("_ok"), F.json_object_keys("_body"))).withColumn(
        "config", F.when(F.col("_keys").isNotNull(), F.from_json("_body", _CONFIG_SCHEMA))
    )
    labels, prompts = F.col("config.class_labels"), F.map_keys("config.prompts")
    missing = F.size(F.array_except(F.array(*map(F.lit, CONFIG_KEYS)), F.col("_keys"))) > 0
    n_labels = F.coalesce(F.size(labels), F.lit(0))
    no_labels = labels.isNull() | (n_labels <= 0)
    mismatch = (
        F.col("config.prompts").isNull()
        | (F.size(F.array_except(labels, prompts)) > 0)
        | (F.size(F.array_except(prompts, labels)) > 0)
    )
    # Checks run in order and the first that fails is reported, then the label count.
    errors = F.when(F.col("_keys").isNull(), F.array(F.lit("invalid_json"))).otherwise(
        F.array_compact(
            F.array(
                F.when(missing, "missing_keys"),
                F.when(~missing & no_labels, "no_class_labels"),
                F.when(~missing & ~no_labels & mismatch, "prompt_keys_differ"),
                F.when(~missing & ~no_labels & (F.size(F.array_distinct(labels)) < 2), "fewer_than_two_labels"),
            )
        )
    )
    sorted_labels = F.array_sort(F.array_distinct(labels))
    fixed = F.when(F.col("config").isNotNull(), F.col("config").withField("class_labels", sorted_labels))
    return parsed.withColumn("config", fixed).withColumn("errors", errors).drop("_body", "_ok", "_keys")


def apply_refinement(
    configs: DataFrame, replies: DataFrame, key: str = "config_id", response: str = "response"
) -> DataFrame:
    """Prompts after a refinement reply, one row per configuration and class.

    ``configs`` is ``(key, prompts map)``. A reply that is malformed, lacks a key or names other
    classes changes nothing. ``accepted`` tells which; ``changed`` is per class.
    """
    body = strip_fence(F.col(response))
    parsed = replies.select(key, F.when(one_json_value(body), F.from_json(body, _REFINEMENT_SCHEMA)).alias("r"),
                            F.when(one_json_value(body), F.json_object_keys(body)).alias("_keys"))
    both = configs.join(parsed, key, "left")
    old, new = F.map_keys("prompts"), F.map_keys("r.refined_prompts")
    accepted = F.coalesce(
        (F.size(F.array_except(F.array(*map(F.lit, REFINEMENT_KEYS)), F.col("_keys"))) == 0)
        & (F.size(F.array_except(old, new)) == 0)
        & (F.size(F.array_except(new, old)) == 0),
        F.lit(False),
    )
    rows = both.withColumn("accepted", accepted).select(
        key, "accepted", F.col("r.evaluation_summary").alias("evaluation"), "r.refined_prompts",
        F.explode("prompts").alias("class_label", "previous_prompt"),
    )
    fresh = F.when(F.col("accepted"), F.element_at("refined_prompts", F.col("class_label")))
    return rows.select(
        key,
        "class_label",
        "previous_prompt",
        F.coalesce(fresh, "previous_prompt").alias("prompt"),
        F.coalesce(fresh != F.col("previous_prompt"), F.lit(False)).alias("changed"),
        "accepted",
        F.when(F.col("accepted"), F.col("evaluation")).alias("evaluation"),
    )


def refinement_history(refined: DataFrame, cycle: int, key: str = "config_id") -> DataFrame:
    """History row per configuration: both prompt maps (one entry per class) and the evaluation."""
    return refined.groupBy(key).agg(
        F.lit(cycle).alias("cycle"),
        F.max("evaluation").alias("evaluation"),
        F.map_from_entries(F.collect_list(F.struct("class_label", "previous_prompt"))).alias("previous_prompts"),
        F.map_from_entries(F.collect_list(F.struct("class_label", "prompt"))).alias("refined_prompts"),
    )


def labelling_batches(df: DataFrame, size: int = LABELLING_BATCH_SIZE, row_id: str = "row_id") -> DataFrame:
    """Number rows for labelling: ``batch`` and the index within it, from the row id."""
    return df.withColumn("batch", block(F.col(row_id), size)).withColumn(
        "idx", F.pmod(F.col(row_id), F.lit(size)).cast("int")
    )


def apply_assignments(
    df: DataFrame, replies: DataFrame, allowed: list[str] | DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Replace labels by the teacher's assignments, batch by batch.

    ``df`` is ``(row_id, batch, idx, text, label)``, ``replies`` is ``(batch, response)``. Labels
    outside ``allowed`` are dropped; a row left without any keeps its own. Indices missing from a
    reply drop their row and unknown indices are ignored. Batches without a usable reply keep
    their original rows.
    """
    if isinstance(allowed, DataFrame):
        allowed = [r[0] for r in allowed.collect()]
    permitted = F.array(*map(F.lit, allowed))
    kept = lambda e: F.filter(e["value"], lambda x: F.array_contains(permitted, x))
    # Answers stay in one array per batch, so that each row of the data is joined once.
    entries = last_entries(parse_object(json_span(F.col("response")), "array<string>"))
    answers = replies.select(
        "batch",
        F.transform(
            entries,
            lambda e: F.struct(F.trim(e["key"]).try_cast("int").alias("idx"), F.array_join(kept(e), ",").alias("label")),
        ).alias("answers"),
    )
    own = F.col("label").cast("string")
    found = F.transform(F.filter("answers", lambda a: a["idx"] == F.col("idx")), lambda a: F.coalesce(F.nullif(a["label"], F.lit("")), own))
    return df.join(answers, "batch", "left").select(
        row_id, "text", F.explode(F.when(F.col("answers").isNull(), F.array(own)).otherwise(found)).alias("label")
    )


def preview_by_class(results: DataFrame, classes: DataFrame, n: int = 3, width: int = 100) -> DataFrame:
    """First ``n`` non-blank response lines of each class in one text; classes without any say so.

    The per-class limit is constant, so each partition passes on ``n`` lines per class at most.
    """
    lines = results.filter(F.col("status") == "success").select(
        "class_label", "seq", F.posexplode(F.split("response", "\n")).alias("pos", "line")
    )
    lines = lines.select("class_label", "seq", "pos", strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    lines = lines.withColumn("line", ellipsis(F.col("line"), width, "always"))
    order = W.partitionBy("class_label").orderBy("seq", "pos")
    first = lines.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    shown = F.concat(F.lit("  - "), F.col("line"))
    texts = first.groupBy("class_label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", shown.alias("s")))), lambda x: x["s"]), "\n").alias("body")
    )
    head = F.concat(F.lit("* Samples for Class '"), F.col("class_label"), F.lit("':"))
    return classes.select("class_label").distinct().join(texts, "class_label", "left").select(
        "class_label",
        F.when(F.col("body").isNotNull(), F.concat(head, F.lit("\n"), "body"))
        .otherwise(F.concat(head, F.lit(" No samples generated.")))
        .alias("preview"),
    )
