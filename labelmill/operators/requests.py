"""Request planning, teacher calls, quotas and counters."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.operators.ledger import Ledger

# Rows expected per request, smallest target per class, requests per batch.
ROWS_PER_REQUEST = 50
ROWS_PER_EDGE_REQUEST = 40
MIN_PER_CLASS = 2500
BATCH_SIZE = 10
LABELLING_BATCH_SIZE = 15

# Bytes of prompts that a task hands to a teacher at a time, so that its memory follows this and not Arrow's batches.
SLICE_BYTES = 1 << 20

RESULT_SCHEMA = (
    "seq bigint, batch bigint, class_label string, prompt_type string, prompt string, response string, status string, "
    "error string"
)


def target_per_class(volume: int, n_classes: int, min_per_class: int = MIN_PER_CLASS) -> int:
    """Rows wanted per class; small volumes are lifted to the floor."""
    return max(min_per_class, volume // n_classes)


def plan_requests(
    classes: DataFrame,
    target: int,
    per_request: int = ROWS_PER_REQUEST,
    prompt_type: str = "training_data",
    requests: int | None = None,
) -> DataFrame:
    """One row per request: every class that has a prompt, ``max(1, round(target / per_request))`` times.

    ``classes`` is ``(class_label, prompt)``, one row per class. Rounding is half to even.
    ``requests`` overrides the number, for previews.
    """
    times = F.lit(requests) if requests else F.greatest(F.lit(1), F.bround(F.lit(target / per_request), 0).cast("int"))
    usable = classes.filter(F.coalesce(F.length("prompt"), F.lit(0)) > 0)
    # One row per class: this window numbers classes, not data.
    ordered = usable.withColumn("ord", F.row_number().over(W.orderBy("class_label")) - 1)
    return ordered.select(
        "class_label",
        "prompt",
        F.lit(prompt_type).alias("prompt_type"),
        F.col("ord"),
        times.alias("times"),
        F.explode(F.sequence(F.lit(1), times)).alias("nth"),
    ).select(
        (F.col("ord") * F.col("times") + F.col("nth")).cast("bigint").alias("seq"), "class_label", "prompt_type", "prompt"
    )


def classes_without_prompt(classes: DataFrame) -> DataFrame:
    """Classes that the plan drops."""
    return classes.filter(F.coalesce(F.length("prompt"), F.lit(0)) == 0).select("class_label")


def block(number: Column, size: int) -> Column:
    """Index of the block of ``size`` consecutive numbers, in whole-number arithmetic."""
    return F.call_function("div", number - F.pmod(number, F.lit(size)), F.lit(size)).cast("bigint")


def with_batches(df: DataFrame, size: int = BATCH_SIZE, seq: str = "seq") -> DataFrame:
    """Add ``batch``: consecutive runs of ``size`` by the plan's own number, from 0."""
    return df.withColumn("batch", block(F.col(seq) - 1, size))


def one_by_one(answer: Callable) -> Callable[[pd.DataFrame], list]:
    """A teacher for ``teacher_map`` from a function of one request ``(seq, prompt)``; what it raises stays with its request."""

    def answers(frame: pd.DataFrame) -> list:
        found = []
        for seq, prompt in zip(frame["seq"], frame["prompt"], strict=True):
            try:
                found.append(answer(seq, prompt))
            except Exception as error:  # any failure of the teacher belongs to its request
                found.append(error)
        return found

    return answers


def teacher_map(
    requests: DataFrame, fn: Callable[[pd.DataFrame], list], parallelism: int | None = None, ledger: str | None = None, per_call: int = 1
) -> DataFrame:
    """Apply a teacher to every request, in parallel over partitions.

    ``fn`` gets a pandas frame of requests, of about ``SLICE_BYTES`` of prompts, and returns for each row a response or an exception, which marks its
    own row as ``failed`` (see ``one_by_one``). If ``fn`` itself raises, nothing is known of its rows: all of that
    call's are ``failed``, and none is asked again. Empty responses are ``failed_empty``. ``error`` says why a
    row failed. ``parallelism`` bounds the number of concurrent calls.

    With ``ledger``, a folder that all executors reach, requests are asked ``per_call`` at a time, and each call's
    answers are recorded before the next call. A task or job that runs again asks only for what has no record, so a
    request is asked once, or again if its task died during the call. Two attempts at the same time would both ask, so
    speculative execution is an error. Without a ledger, write the result before using it in several jobs or sorting
    it: each job over an unwritten plan, and each new attempt of a task, asks anew.
    """
    if "batch" not in requests.columns:
        requests = with_batches(requests)
    if parallelism:
        requests = requests.repartition(parallelism, "seq")
    if ledger and requests.sparkSession.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("with a ledger, set spark.speculation to false: two attempts at a time would both ask")

    def outcome(answer) -> dict:
        if isinstance(answer, Exception):
            return {"response": None, "status": "failed", "error": f"{type(answer).__name__}: {answer}"}
        return {"response": str(answer), "status": "success", "error": None} if answer else {"response": None, "status": "failed_empty", "error": "empty response"}

    def asked(frame: pd.DataFrame) -> list[dict]:
        try:
            answers = list(fn(frame))
            if len(answers) != len(frame):
                raise ValueError(f"{len(answers)} responses to {len(frame)} requests")
        except Exception as error:
            answers = [error] * len(frame)
        return list(map(outcome, answers))

    def recorded(frame: pd.DataFrame, book: Ledger) -> list[dict]:
        found = book.found(frame)
        open_ = [i for i, f in enumerate(found) if f is None]
        for start in range(0, len(open_), per_call):
            rows = open_[start : start + per_call]
            part = frame.iloc[rows]
            for i, seq, prompt, answer in zip(rows, part["seq"], part["prompt"], asked(part), strict=True):
                book.record(seq, prompt, answer)
                found[i] = answer
        return found

    slice_bytes = SLICE_BYTES

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = total = 0
        for row, n in enumerate(pc.fill_null(pc.binary_length(batch["prompt"]), 0).to_pylist()):
            if row > start and total + n > slice_bytes:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Ledger(ledger) if ledger else None
        for batch in batches:
            for part in sliced(batch):
                frame = part.to_pandas()
                answers = recorded(frame, book) if book else asked(frame)
                outcomes = [pa.array([a[c] for a in answers], pa.string()) for c in ("response", "status", "error")]
                yield pa.RecordBatch.from_arrays([*part.columns, *outcomes], [*part.schema.names, "response", "status", "error"])
        # The worker lives on: what this task no longer needs goes back to the system.
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    sent = {"seq": "bigint", "batch": "bigint", "class_label": "string", "prompt_type": "string", "prompt": "string"}
    return requests.select(*[F.col(c).cast(t).alias(c) for c, t in sent.items()]).mapInArrow(call, RESULT_SCHEMA)


def apply_quota(samples: DataFrame, classes: DataFrame, target: int) -> DataFrame:
    """Keep samples up to the batch in which the last class reached ``target`` rows.

    ``samples`` has ``(class_label, batch, …)``; ``classes`` lists every class that must reach
    the target. If one never does, everything is kept. The running sums see batch counts only.
    """
    counts = samples.groupBy("class_label", "batch").agg(F.count("*").alias("n"))
    upto = W.partitionBy("class_label").orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = (
        counts.withColumn("total", F.sum("n").over(upto))
        .filter(F.col("total") >= target)
        .groupBy("class_label")
        .agg(F.min("batch").alias("batch"))
    )
    wanted = classes.select("class_label").distinct()
    stop = wanted.join(reached, "class_label", "left").agg(
        F.when(F.count("*") == F.count("batch"), F.max("batch"))
    ).scalar()
    return samples.filter(F.coalesce(F.col("batch") <= stop, F.lit(True)))


def generation_stats(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Requests, failures and samples per class and batch, with totals per class and overall.

    Total rows carry null in the columns they sum over.
    """
    asked = results.groupBy("class_label", "batch").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") != "success").alias("failed")
    )
    added = samples.groupBy("class_label", "batch").agg(F.count("*").alias("samples"))
    both = asked.join(added, ["class_label", "batch"], "left")
    return both.rollup("class_label", "batch").agg(
        F.sum("requests").alias("requests"),
        F.sum("failed").alias("failed"),
        F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"),
    )
