"""Data generation with an injected teacher: plan, call, log, parse, stop at the quota, append, check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.prompts import EDGE_TEMPLATE, render
from labelmill.operators import requests as req
from labelmill.operators.duplicates import duplicate_report
from labelmill.operators.replies import parse_samples
from labelmill.operators.synthesis import synthesise_multilabel
from labelmill.session import listed, materialise, scratch_path
from labelmill.sources.writers import append_samples, log_responses

# Batches that are sent before the counts are looked at again.
WAVE = 10


@dataclass
class Generated:
    """Accepted samples, counters and the duplicate report of a generation run."""

    samples: DataFrame
    stats: DataFrame
    duplicates: DataFrame
    log: str


def _collect(
    plan: DataFrame,
    classes: DataFrame,
    fn: Callable,
    target: int,
    batch_size: int,
    out: str | None,
    log: str | None,
    parallelism: int | None,
    wave: int | None,
    run: str | None = None,
) -> Generated:
    """Run a request plan, ``wave`` batches at a time; no further wave starts once every class has its target.

    Waves run as one as long as none of them can be the last: a class below its target needs at least its next
    request, so every batch up to that of the class that is asked last is sent before the counts are looked at.
    Plan and classes are written once, so that no wave reads again what they were made from.

    Answers are recorded in a ledger one by one, so a lost task doesn't ask again. Each wave's responses are written
    before anything else and are parsed once; the running counts read the parsed samples' labels only. ``wave=None``
    sends all requests at once. With a ``run`` name, ``out`` and ``log`` are tables of batches, and the ledger lies next
    to ``log``: a run that is started again under its name asks only for what it has no answers to, and appends once.
    """
    spark = plan.sparkSession
    log = log or scratch_path(spark, "responses")
    answered, parsed = scratch_path(spark, "answered"), scratch_path(spark, "parsed")
    ledger = f"{log.rstrip('/')}_ledger/{run}" if run else scratch_path(spark, "ledger")
    plan, classes = materialise(req.with_batches(plan, batch_size), "plan"), materialise(classes, "classes")
    n_batches = plan.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    step = wave or max(n_batches, 1)
    open_classes, start = classes, 0
    while start < max(n_batches, 1):
        end = start + step
        if wave:
            # The next batch of each open class, and whether one has none left and keeps all others going.
            left = plan.filter(F.col("batch") >= start).groupBy("class_label").agg(F.min("batch").alias("next"))
            needed = open_classes.join(left, "class_label", "left").agg(F.max("next").alias("next"), F.count_if(F.isnull("next")).alias("spent")).first()
            last = n_batches - 1 if needed["spent"] else needed["next"] or 0
            end = max(end, (last // step + 1) * step)
        part = plan.filter(F.col("batch").between(start, end - 1))
        this = f"{answered}/wave={start}"
        req.teacher_map(part, fn, parallelism or spark.sparkContext.defaultParallelism, ledger).write.parquet(this)
        replies = spark.read.parquet(this)
        log_responses(replies, log, batch=f"{run}-{start}" if run else None)
        parse_samples(replies).write.mode("append").parquet(parsed)
        if wave:
            counts = spark.read.parquet(parsed).groupBy("class_label").agg(F.count("*").alias("n"))
            open_classes = classes.join(counts.filter(F.col("n") >= target), "class_label", "left_anti")
            if open_classes.isEmpty():
                break
        start = end
    results = spark.read.parquet(answered).drop("wave")
    samples = req.apply_quota(spark.read.parquet(parsed), classes, target)
    samples = samples.select("seq", "pos", "batch", "class_label", "text", F.col("class_label").alias("label"))
    if out:
        append_samples(samples, out, batch=run)
    return Generated(samples, req.generation_stats(results, samples), duplicate_report(samples), log)


def generate_training(
    classes: DataFrame,
    fn: Callable,
    volume: int = 1000,
    min_per_class: int = req.MIN_PER_CLASS,
    batch_size: int = req.BATCH_SIZE,
    out: str | None = None,
    log: str | None = None,
    parallelism: int | None = None,
    wave: int | None = WAVE,
    run: str | None = None,
) -> Generated:
    """Single-label training data for ``(class_label, prompt)`` classes."""
    usable = classes.filter(F.coalesce(F.length("prompt"), F.lit(0)) > 0)
    target = req.target_per_class(volume, max(classes.count(), 1), min_per_class)
    plan = req.plan_requests(classes, target)
    return _collect(plan, usable, fn, target, batch_size, out, log, parallelism, wave, run)


def generate_multilabel(classes: DataFrame, fn: Callable, seed: int = 42, **options) -> DataFrame:
    """Single-label generation followed by multi-label synthesis."""
    made = generate_training(classes, fn, **options)
    # A sample is known by its request and position; a response holds far fewer than 2**20 samples.
    rows = made.samples.select((F.col("seq") * (1 << 20) + F.col("pos")).alias("row_id"), "text", "label")
    labels = sorted(listed(classes.select("class_label").distinct(), "class_label"))
    return synthesise_multilabel(rows, labels, seed)


def edge_prompts(classes: DataFrame, problem: str, classification_type: str, language: str = "english") -> DataFrame:
    """Edge-case prompt of every class."""
    names = sorted(listed(classes.select("class_label").distinct(), "class_label"))
    return classes.select(
        "class_label",
        render(
            EDGE_TEMPLATE,
            class_label=F.col("class_label"),
            classification_type=F.lit(classification_type),
            problem=F.lit(problem),
            classes=F.lit(", ".join(names)),
            language=F.lit(language),
        ).alias("prompt"),
    )


def _exists(spark, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def generate_edge_cases(
    classes: DataFrame,
    fn: Callable,
    problem: str,
    classification_type: str,
    per_class: int = 100,
    language: str = "english",
    batch_size: int = req.BATCH_SIZE,
    out: str | None = None,
    **options,
) -> Generated | None:
    """Hard test data: own prompts, 40 rows per request, half the batch size; skipped if ``out`` already exists."""
    if out and _exists(classes.sparkSession, out):
        return None
    prompts = edge_prompts(classes, problem, classification_type, language)
    plan = req.plan_requests(prompts, per_class, req.ROWS_PER_EDGE_REQUEST, "edge_case")
    settings = {"log": None, "parallelism": None, "wave": WAVE, "run": None} | options
    return _collect(plan, prompts, fn, per_class, max(1, batch_size // 2), out, **settings)
