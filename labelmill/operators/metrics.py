"""Classification metrics and result samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.text import ellipsis, is_correct
from labelmill.operators.sampling import rows_by_id
from labelmill.session import local_copy


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(
        F.avg(is_correct(F.col(label), F.col(predicted)).cast("double")).alias("accuracy"),
        F.count("*").alias("n_rows"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    The data is aggregated once, to the confusion counts; everything after works on classes.
    """
    confusion = df.groupBy(
        F.col(label).cast("string").alias("label"), F.col(predicted).cast("string").alias("pred")
    ).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    # Each confusion cell counts once for its true class and once for its predicted class.
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).alias("said"), hit.alias("tp")),
                F.struct(F.col("pred").alias("class"), F.lit(0).alias("truth"), F.col("n").alias("said"), F.lit(0).alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    classes = (
        sides.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.sum("truth").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
        .withColumn("precision", _ratio(F.col("tp"), F.col("said")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("said")))
    )
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    hits = F.sum("tp") / total
    averages = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), hits.alias("precision"), hits.alias("recall"), hits.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return classes.select("class", "precision", "recall", "f1", "support").unionByName(averages)


def label_cells(df: DataFrame, truth: str = "y", prob: str = "prob", labels: list[str] | None = None) -> DataFrame:
    """Long form ``(label, y, p)`` of array columns: one row per row and label."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("y"), F.col(prob).alias("p"))).alias("pos", "cell"))
    names = F.array(*map(F.lit, labels))[F.col("pos")] if labels else F.col("pos").cast("string")
    return cells.select(names.alias("label"), F.col("cell.y").cast("double").alias("y"), F.col("cell.p").cast("double").alias("p"))


def element_accuracy(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of label cells predicted right."""
    said = (F.col("p") >= threshold).cast("double")
    return cells.agg(F.avg((said == F.col("y")).cast("double")).alias("element_accuracy"), F.count("*").alias("n_cells"))


def cell_log_loss(eps: float = 1e-15) -> Column:
    """Binary cross-entropy of a cell, with the probability kept inside (0, 1)."""
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    return -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))


def multilabel_log_loss(cells: DataFrame) -> DataFrame:
    """Mean over labels of the mean log-loss; NaN if a label has only one truth value."""
    per_label = cells.groupBy("label").agg(F.avg(cell_log_loss()).alias("loss"), (F.min("y") < F.max("y")).alias("both"))
    return per_label.agg(
        F.when(F.bool_and("both"), F.avg("loss")).otherwise(F.lit(float("nan"))).alias("log_loss"),
        F.count("*").alias("n_labels"),
    )


def binary_metrics(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, binary accuracy and loss over all cells."""
    said, y = F.col("p") >= threshold, F.col("y") == 1.0
    counts = cells.agg(
        F.count_if(said & y).alias("tp"),
        F.count_if(said & ~y).alias("fp"),
        F.count_if(~said & y).alias("fn"),
        F.avg((said == y).cast("double")).alias("binary_accuracy"),
        F.avg(cell_log_loss()).alias("loss"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "binary_accuracy",
        "loss",
    )


def error_sample(
    df: DataFrame, labels: list[str] | None = None, limit: int = 20, row_id: str = "row_id"
) -> DataFrame:
    """First wrong rows (half the limit), filled up with correct rows, each as one line of text.

    A row without a label or prediction is wrong; what is null is shown as such.

    The rows are chosen on ids alone; texts and probabilities are read for the chosen ones only.
    """
    same = F.coalesce(is_correct(F.col("label"), F.col("predicted_label")), F.lit(False))
    narrow = df.select(row_id, same.alias("is_correct"))
    first = lambda condition, n: narrow.filter(condition).orderBy(row_id).limit(n)
    # One and a half times the limit at most.
    found = local_copy(first(~F.col("is_correct"), limit // 2).unionByName(first(F.col("is_correct"), limit)))
    nth = F.row_number().over(W.orderBy("is_correct", row_id))
    chosen = found.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")
    probs = [l for l in (labels or []) if f"{l}_prob" in df.columns]
    info = F.lit("")
    if probs:
        said = lambda l: F.coalesce(F.format_string("%.3f", F.col(f"{l}_prob").cast("double")), F.lit("null"))
        shown = [F.concat(F.lit(f"{l}: "), F.when(F.col(f"{l}_prob").isNull(), "null").otherwise(said(l))) for l in probs]
        info = F.concat(F.lit(" (Probs: "), F.concat_ws(", ", *shown), F.lit(")"))
    named = lambda c: F.coalesce(c, F.lit("null"))
    # Fixed value: the layout of a line.
    line = F.concat(
        F.lit('- Text: "'), named(ellipsis(F.col("text"), 150, "always")),
        F.lit('", True: '), named(F.col("label").cast("string")),
        F.lit(", Predicted: "), named(F.col("predicted_label").cast("string")), info,
    )
    shown = rows_by_id(df, chosen, row_id)
    return shown.join(chosen, row_id).select(row_id, "is_correct", line.alias("line"))
