"""Preparation of a user table: load, analyse, route, convert, standardise, save."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.text import clean_text
from labelmill.operators.labels import drop_empty, to_binary, to_label_array, to_multiclass, to_multilabel, to_single_label
from labelmill.operators.profile import detect_activation, individual_labels, infer_roles, infer_task, label_structure
from labelmill.operators.sampling import balance, sample_n
from labelmill.operators.synthesis import synthesise_multilabel
from labelmill.session import MOST_LABELS, materialise
from labelmill.sources.readers import load_data, with_row_id
from labelmill.sources.writers import save_dataset


@dataclass
class Prepared:
    """A standardised table and the decision that led to it."""

    df: DataFrame
    decision: dict = field(default_factory=dict)


def analyse(df: DataFrame, row_id: str = "row_id", reply: dict | None = None) -> dict:
    """Decision record for a table; a teacher's own analysis may be given as ``reply`` and takes precedence."""
    decision = infer_roles(df, row_id).first().asDict()
    decision |= {"needs_conversion": False, "conversion_feasible": False}
    return decision | (reply or {})


def route(decision: dict, activation: str = "auto") -> dict:
    """Final task, activation and whether to convert, from the analysis and the user's preference."""
    task, convert = decision["task"], decision["needs_conversion"] and decision["conversion_feasible"]
    if activation == "sigmoid":
        # An infeasible request is still honoured, by conversion.
        return {
            "final_task": "multilabel",
            "activation": "sigmoid",
            "convert": "synthesise" if convert or not decision["sigmoid_feasible"] else None,
        }
    if activation == "softmax":
        return {
            "final_task": "multiclass",
            "activation": "softmax",
            "convert": "first_label" if task == "multilabel" else None,
        }
    if activation != "auto":
        raise ValueError(f"unknown activation {activation!r}")
    if task == "binary":
        return {"final_task": "binary", "activation": "sigmoid", "convert": None}
    if decision["recommended"] == "sigmoid":
        return {"final_task": "multilabel", "activation": "sigmoid", "convert": "synthesise" if convert else None}
    return {"final_task": "multiclass", "activation": "softmax", "convert": None}


def standardise(
    df: DataFrame,
    decision: dict,
    clean: bool = False,
    max_samples: int | None = None,
    balance_classes: bool = False,
    row_id: str = "row_id",
) -> DataFrame:
    """Table in standard form for the final task, optionally cleaned, balanced and capped by seeded sampling."""
    text, label, task = decision["text_column"], decision["label_column"], decision["final_task"]
    for name, column in (("text", text), ("label", label)):
        if not column or column not in df.columns:
            raise ValueError(f"{name} column {column!r} not found in {df.columns}")
    convert = {"binary": to_binary, "multiclass": to_multiclass, "multilabel": to_multilabel}[task]
    if task == "multilabel":
        # One column per label up to a stated width; beyond it the labels stay an array, and the decision says so.
        wide = individual_labels(df, label).limit(MOST_LABELS + 1).count() > MOST_LABELS
        decision["label_form"] = "array" if wide else "columns"
        convert = to_label_array if wide else to_multilabel
    out = convert(df, text, label, row_id=row_id)
    if clean:
        # The expression is null-preserving here, so that rows without text can still be dropped.
        out = out.withColumn("text", F.when(F.col("text").isNotNull(), clean_text(F.col("text"))))
    out = drop_empty(out, cleaned=clean)
    if clean and (max_samples or balance_classes and task == "binary"):
        out = materialise(out, "cleaned")  # sampling counts rows several times, and cleaning reads every character
    if balance_classes and task == "binary":
        out = balance(out, max_samples, row_id=row_id)
    return sample_n(out, max_samples, row_id=row_id) if max_samples else out


def prepare_table(
    df: DataFrame,
    clean: bool = False,
    max_samples: int | None = None,
    balance_classes: bool = False,
    activation: str = "auto",
    reply: dict | None = None,
    row_id: str = "row_id",
) -> Prepared:
    """All preparation steps on a table that has a row id; nothing is written."""
    decision = analyse(df, row_id, reply)
    decision |= route(decision, activation)
    text, label = decision["text_column"], decision["label_column"]
    if decision["convert"] == "synthesise" and text and label:
        made = synthesise_multilabel(df, text=text, label=label, row_id=row_id)
        # (kind, seq) identifies a synthetic row; interleaving keeps the pair in one number.
        df = made.select((F.col("seq") * 4 + F.col("kind")).alias(row_id), F.col("text").alias(text), F.col("label").alias(label))
    elif decision["convert"] == "first_label":
        df = to_single_label(df, label)
    return Prepared(standardise(df, decision, clean, max_samples, balance_classes, row_id), decision)


def prepare(
    spark: SparkSession,
    path: str,
    out: str | None = None,
    clean: bool = False,
    max_samples: int | None = None,
    balance_classes: bool = False,
    activation: str = "auto",
    reply: dict | None = None,
    fmt: str = "parquet",
    kind: str | None = None,
) -> Prepared:
    """Prepare a user file. Row ids are fixed by writing the loaded table once to the shared folder."""
    loaded, _ = load_data(spark, path, kind)
    table = materialise(with_row_id(loaded), "loaded")
    ready = prepare_table(table, clean, max_samples, balance_classes, activation, reply)
    if out:
        ready.df = materialise(ready.df, "ready")  # written, reported on and returned
        save_dataset(ready.df.drop("row_id"), out, clean, fmt, ready.decision)
    return ready


def own_data_config(df: DataFrame, task: str | None = None, preference: str = "auto", label: str = "label") -> DataFrame:
    """Configuration row for a prepared user table: final type, activation, classes and volume.

    Without a task from the analysis report, the labels decide it.
    """
    if task is None:
        task = infer_task(df, label).first()["task"]
    decided = detect_activation(label_structure(df, label), task, preference)
    if task == "multilabel":
        names = individual_labels(df, label)
    else:
        names = df.select(F.col(label).cast("string").alias("label")).filter("label is not null").distinct()
    classes = names.agg(F.count("*").alias("n_classes"), F.min("label").alias("first"), F.max("label").alias("last"))
    return decided.select(
        F.concat(F.lit("User-provided dataset for "), "final_type", F.lit(" classification")).alias("summary"),
        F.col("final_type").alias("classification_type"),
        "activation",
        "confidence",
        F.concat(F.lit(f"user_dataset_{task}_"), "activation").alias("model_prefix"),
        classes.select("n_classes").scalar().alias("n_classes"),
        df.agg(F.count("*")).scalar().alias("training_data_volume"),
    )
