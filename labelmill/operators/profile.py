"""Column profiles, label statistics and the decisions drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from labelmill.functions.text import ellipsis, split_labels, strip

# Parts of a column name that mark it as text or as label.
TEXT_NAMES = ("text", "content", "message", "review", "comment", "description")
LABEL_NAMES = ("label", "class", "category", "target", "sentiment")

# Values longer than this are grouped by digest when only their number is wanted.
_INLINE_LENGTH = 40

# Rows read to rule out columns with many values.
_HEAD_ROWS = 1000


def _columns(df: DataFrame, row_id: str | None) -> list[str]:
    return [c for c in df.columns if c != row_id]


def _long_form(df: DataFrame, columns: list[str], shorten: bool) -> DataFrame:
    """One row per cell: ``(col, value)`` with ``col`` the position in ``columns``."""
    types = dict(df.dtypes)

    def cell(i: int, c: str) -> Column:
        v = F.col(c).cast("string")
        return F.struct(F.lit(i).alias("col"), (_short(v) if shorten and types[c] == "string" else v).alias("value"))

    cells = [cell(i, c) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def _short(v: Column) -> Column:
    """A string itself, marked, or its digest if it is long; equal exactly if the strings are."""
    digest = F.concat(F.lit("d"), F.sha2(v, 256))
    return F.when(F.length(v) <= _INLINE_LENGTH, F.concat(F.lit("t"), v)).otherwise(digest)


def _named(columns: list[str]) -> Column:
    return F.array(*map(F.lit, columns))[F.col("col")].alias("column_name")


def few_valued(df: DataFrame, columns: list[str], high: int) -> list[str]:
    """Columns that may have at most ``high`` distinct values.

    A column with more values than that among the first rows certainly has too many, so ids and
    texts are ruled out by reading one partition; only the rest needs an exact count.
    """
    types = dict(df.dtypes)
    cells = [_short(F.col(c)) if types[c] == "string" else F.col(c).cast("string") for c in columns]
    head = df.select(*[v.alias(f"c{i}") for i, v in enumerate(cells)]).take(_HEAD_ROWS)
    return [c for i, c in enumerate(columns) if len({r[i] for r in head} - {None}) <= high]


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Type, distinct count (nulls excluded) and null count of each column.

    The exact form groups cells by column and value after a map-side combine, with long
    values replaced by digests, so neither texts nor hot values are shuffled in bulk.
    ``exact=False`` takes one pass of sketches and needs no shuffle of values at all.
    """
    columns = columns or df.columns
    types = dict(df.dtypes)
    known = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    if exact:
        cells = _long_form(df, columns, True).groupBy("col", "value").agg(F.count("*").alias("n"))
        stats = (
            cells.groupBy("col")
            .agg(
                F.count("value").alias("unique_count"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            )
            .select(_named(columns), "unique_count", "null_count")
        )
    else:
        row = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"))).alias("unique_count"),
                    F.count_if(F.col(c).isNull()).alias("null_count"),
                ).alias(f"c{i}")
                for i, c in enumerate(columns)
            ]
        )
        stats = row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))
    return stats.select("column_name", known[F.col("column_name")].alias("data_type"), "unique_count", "null_count")


def value_counts(
    df: DataFrame, columns: list[str] | None = None, low: int = 2, high: int = 50, top: int = 10
) -> DataFrame:
    """Value counts of the columns that could hold labels (``low``..``high`` distinct values).

    Columns with too many values are ruled out from the first rows; the remaining ones are counted
    in one scan that reads nothing else. ``is_top`` marks the ``top`` most frequent values.
    """
    chosen = few_valued(df, columns or df.columns, high)
    if not chosen:
        empty = "column_name string, value string, n bigint, is_top boolean"
        return df.sparkSession.createDataFrame([], empty)
    counts = _long_form(df, chosen, False).groupBy("col", "value").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("value").isNotNull())
    wanted = counts.groupBy("col").agg(F.count("*").alias("values")).filter(F.col("values").between(low, high))
    kept = counts.join(wanted.select("col"), "col", "left_semi")
    # At most ``high`` rows per column reach this window.
    order = W.partitionBy("col").orderBy(F.desc("n"), "value")
    return kept.withColumn("is_top", F.row_number().over(order) <= top).select(_named(chosen), "value", "n", "is_top")


def text_stats(df: DataFrame, columns: list[str] | None = None, min_mean: float = 100.0) -> DataFrame:
    """Mean and maximum length per string column; ``is_text`` marks means above ``min_mean``."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.avg(F.length(c)).alias("mean_length"),
                F.max(F.length(c)).cast("bigint").alias("max_length"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    stats = row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))
    return stats.withColumn("is_text", F.coalesce(F.col("mean_length") > min_mean, F.lit(False)))


def _first_values(df: DataFrame, columns: list[str], order: str, n: int, value) -> DataFrame:
    """``(order, column_name, value)`` of the first ``n`` non-null values of each column, in one scan.

    The constant limit per column is applied inside each partition before anything is shuffled.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in columns])
    long = df.select(order, F.inline(cells)).filter(F.col("value").isNotNull())
    return long.withColumn("_nth", F.row_number().over(W.partitionBy("column_name").orderBy(order))).filter(F.col("_nth") <= n).drop("_nth")


def text_samples(df: DataFrame, columns: list[str], row_id: str, n: int = 3, width: int = 200) -> DataFrame:
    """First ``n`` non-null values of each column, cut to ``width`` characters, so that only short strings move."""
    cut = lambda c: F.when(F.col(c).isNotNull(), ellipsis(F.col(c), width, "never"))
    return _first_values(df, columns, row_id, n, cut).select(row_id, "column_name", F.col("value").alias("sample"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def label_structure(df: DataFrame, label: str = "label") -> DataFrame:
    """One row on how labels are written: separators, mean labels per row, distinct labels, rows."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    has = lambda sign: F.coalesce(F.bool_or(F.contains("label", F.lit(sign))), F.lit(False))
    comma = has(",")
    whole = counts.agg(
        comma.alias("has_comma"),
        has("|").alias("has_pipe"),
        has(";").alias("has_semicolon"),
        F.when(comma, F.sum(F.size(F.split("label", ",")) * F.col("n")) / F.sum("n"))
        .otherwise(F.lit(1.0))
        .alias("mean_labels"),
        F.count("label").alias("whole_labels"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )
    parts = counts.select(F.explode(F.transform(F.split("label", ","), strip)).alias("part"))
    singles = parts.agg(F.countDistinct("part").alias("n")).scalar()
    return whole.select(
        "has_comma",
        "has_pipe",
        "has_semicolon",
        "mean_labels",
        F.when(F.col("has_comma"), singles).otherwise(F.col("whole_labels")).alias("unique_labels"),
        F.col("total").alias("total_rows"),
        (F.col("has_comma") | F.col("has_pipe") | F.col("has_semicolon")).alias("has_indicators"),
    )


def individual_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels after splitting on the comma."""
    whole = df.select(F.col(label).cast("string").alias("label")).distinct()
    return whole.select(F.explode(split_labels(F.col("label"))).alias("label")).distinct().orderBy("label")


def label_cardinality(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows by number of labels, with the share of rows that have more than one."""
    counts = df.groupBy(F.size(F.split(F.col(label).cast("string"), ",")).cast("bigint").alias("n_labels")).agg(
        F.count("*").alias("n_rows")
    )
    share = counts.agg(F.sum(F.when(F.col("n_labels") > 1, F.col("n_rows")).otherwise(0)) / F.sum("n_rows")).scalar()
    return counts.withColumn("multi_share", share)


def newline_check(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of texts that still contain a line break."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.contains(F.col(text), F.lit("\n"))).alias("with_newline")
    )


def analysis_report(df: DataFrame, decision: dict | None = None, label: str = "label") -> DataFrame:
    """Report in long form ``(section, name, value)``: shape, columns, decision and label distribution.

    Long form keeps the label distribution distributed, however many labels there are.
    """
    spark = df.sparkSession
    fixed = [("shape", "columns", str(len(df.columns)))]
    fixed += [("column", c, t) for c, t in df.dtypes]
    fixed += [("decision", k, str(v)) for k, v in (decision or {}).items()]
    head = spark.createDataFrame(fixed, "section string, name string, value string")
    counts = df.groupBy(F.col(label).cast("string").alias("name")).agg(F.count("*").alias("n"))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("value")).select(
        F.lit("shape").alias("section"), F.lit("rows").alias("name"), "value"
    )
    labels = counts.select(F.lit("label_distribution").alias("section"), "name", F.col("n").cast("string").alias("value"))
    return head.unionByName(rows).unionByName(labels)


def infer_roles(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Pick the text and the label column by name, length and number of values; derive the task.

    Best score wins, the earlier column on ties. The result is one row.
    """
    columns = _columns(df, row_id)
    types = dict(df.dtypes)

    def named(c: str, parts: tuple[str, ...]) -> bool:
        return any(p in c.lower() for p in parts)

    # Only unnamed string columns need a look at their first ten values.
    looked_at = [c for c in columns if types[c] == "string" and not named(c, TEXT_NAMES)]
    head_mean = {}
    if looked_at:
        order = row_id or "_order"
        rows = df if row_id else df.withColumn(order, F.monotonically_increasing_id())
        heads = _first_values(rows, looked_at, order, 10, F.length)
        # One row per column.
        head_mean = dict(heads.groupBy("column_name").agg(F.avg("value")).collect())
    listing = df.sparkSession.createDataFrame(
        [
            (i, c, types[c] == "string", named(c, TEXT_NAMES), named(c, LABEL_NAMES), head_mean.get(c))
            for i, c in enumerate(columns)
        ],
        "pos int, column_name string, is_string boolean, text_name boolean, label_name boolean, head_mean double",
    )
    counted = set(few_valued(df, columns, 10)) | {c for c in columns if named(c, LABEL_NAMES)}
    if counted:
        counts = profile(df, [c for c in columns if c in counted]).select("column_name", "unique_count")
        table = listing.join(counts, "column_name", "left")
    else:
        table = listing.withColumn("unique_count", F.lit(None).cast("bigint"))
    scored = table.select(
        "pos",
        "column_name",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.when(F.col("text_name"), 3)
        .when(F.col("is_string") & (F.col("head_mean") > 20), 2)
        .when(F.col("is_string"), 1)
        .alias("text_score"),
        F.when(F.col("label_name"), 3)
        .when(F.coalesce("unique_count", F.lit(0)).between(2, 10), 2)
        .alias("label_score"),
    )
    # Scores compare first, then the earlier position.
    rank = lambda score: F.when(F.col(score).isNotNull(), F.col(score) * 1_000_000 - F.col("pos"))
    best = scored.agg(
        F.max_by("column_name", rank("text_score")).alias("text_column"),
        F.max_by("column_name", rank("label_score")).alias("label_column"),
        F.max_by("unique_count", rank("label_score")).alias("n_classes"),
    )
    enough = F.coalesce(F.col("n_classes") >= 3, F.lit(False))
    return best.select(
        "text_column",
        "label_column",
        F.when(enough, "multiclass").otherwise("binary").alias("task"),
        enough.alias("sigmoid_feasible"),
        F.lit(True).alias("softmax_feasible"),
        F.when(enough, "sigmoid").otherwise("softmax").alias("recommended"),
        F.lit(60).cast("bigint").alias("confidence"),
    )


def detect_activation(structure: DataFrame, task: str, preference: str = "auto") -> DataFrame:
    """Output activation for a label structure (one row in, one row out)."""
    if preference != "auto":
        activation, final, level = F.lit(preference), F.lit(f"{task}_{preference}"), F.lit("user_specified")
    elif task == "binary":
        activation, final, level = F.lit("sigmoid"), F.lit("binary_sigmoid"), F.lit("high")
    else:
        comma, many = F.col("has_comma"), F.col("mean_labels") > 1.2
        activation = F.when(comma | many, "sigmoid").otherwise("softmax")
        final = F.when(comma | many, "multilabel_sigmoid").otherwise(f"{task}_softmax")
        single = "high" if task == "multiclass" else "medium"
        level = F.when(comma, "high").when(many, "medium").otherwise(single)
    return structure.select(
        activation.alias("activation"), final.alias("final_type"), level.alias("confidence"), "unique_labels"
    )


def infer_task(df: DataFrame, label: str = "label") -> DataFrame:
    """Task from the labels alone: comma means multi-label, two labels binary, else multi-class."""
    return label_structure(df, label).select(
        F.when(F.col("has_comma"), "multilabel")
        .when(F.col("unique_labels") == 2, "binary")
        .otherwise("multiclass")
        .alias("task"),
        "unique_labels",
        "total_rows",
    )
