"""Student models: training, scoring, cross-validation and reports on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import is_correct, multi_hot
from labelmill.operators import features as feats
from labelmill.operators.boosting import PATIENCE, fit_boosted
from labelmill.operators.labels import encode_labels, filter_labels
from labelmill.operators.metrics import classification_report
from labelmill.operators.networks import Memory, fit_network, fit_weights, kept, loss_sums, network, packed, sparse_rows
from labelmill.operators.profile import individual_labels
from labelmill.operators.sampling import split_validation, stratified_folds
from labelmill.session import listed

SEED = 42
THRESHOLD = 0.5

# Neural students of a multi-label task whose vectors the driver holds at a time.
MOST_SEARCHES = 2

# Rows of a partition of the feature table, for tables with more than a few partitions.
LEAST_ROWS, MOST_ROWS = 1000, 100_000
TASKS = ("binary", "multiclass", "multilabel")

# The students' published shapes and limits.
BINARY_HIDDEN = (512, 256)
MULTICLASS_HIDDEN = (64,)
BOOSTING = {"maxIter": 500, "stepSize": 0.1, "maxDepth": 5}
LOGREG_ITERATIONS, LOGREG_TOLERANCE = 1000, 1e-4


@dataclass
class Student:
    """A fitted student: one feature transformer, the label list, and one model (one per label if multi-label)."""

    task: str
    name: str
    labels: list[str]
    features: PipelineModel
    models: list[Model]
    history: list[list[float]] = field(default_factory=list)


Trainer = Callable[[DataFrame, int, int, dict], tuple[Model, list[float]]]
_TRAINERS: dict[tuple[str, str], Trainer] = {}


def register(task: str, name: str) -> Callable[[Trainer], Trainer]:
    """Make a trainer available as ``fit(df, task, name)``.

    A trainer gets ``(features, y, is_validation)``, the vector size, the number of classes and
    the caller's parameters; it returns the model and its objective per iteration.
    """

    def add(trainer: Trainer) -> Trainer:
        _TRAINERS[task, name] = trainer
        return trainer

    return add


def _trainer(task: str, name: str) -> Trainer:
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    if (task, name) not in _TRAINERS:
        raise ValueError(f"no student {name!r} for {task}; there are {sorted(_TRAINERS)}")
    return _TRAINERS[task, name]


def _logreg(family: str) -> Trainer:
    def train(data: DataFrame, size: int, classes: int, params: dict):
        rows = params.pop("rows", None) or data.count()
        settings = {"maxIter": LOGREG_ITERATIONS, "tol": LOGREG_TOLERANCE, "regParam": 1.0 / (params.pop("C", 1.0) * rows)} | params
        model = LogisticRegression(
            featuresCol="features", labelCol="y", family=family, standardization=False, **settings
        ).fit(data)
        return model, list(model.summary.objectiveHistory)

    return train


register("multiclass", "logreg")(_logreg("multinomial"))
register("multilabel", "logreg")(_logreg("binomial"))


@register("binary", "gbt")
def _gbt(data: DataFrame, size: int, classes: int, params: dict):
    """Boosted trees; a tenth of the rows decides when ten rounds in a row no longer help, and the best round is kept."""
    settings = BOOSTING | params
    return fit_boosted(data.filter("not is_validation"), data.filter("is_validation"), settings.pop("maxIter"), seed=SEED, **settings)


def _perceptron(layers: list[int], settings: dict) -> MultilayerPerceptronClassifier:
    estimator = MultilayerPerceptronClassifier(**{"featuresCol": "features", "labelCol": "y", "layers": layers, "seed": SEED} | settings)
    if estimator.getSolver() != "l-bfgs":
        raise ValueError("neural students are fitted by l-bfgs")
    return estimator


def _mlp(hidden: tuple[int, ...]) -> Trainer:
    def train(data: DataFrame, size: int, classes: int, params: dict):
        settings = {"maxIter": 100, "hidden": hidden} | params
        layers = [size, *settings.pop("hidden"), classes]
        return fit_network(_perceptron(layers, settings), data)

    return train


register("binary", "mlp")(_mlp(BINARY_HIDDEN))
register("multiclass", "mlp")(_mlp(MULTICLASS_HIDDEN))


def _class_probability(i: int = 1, column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[i]


@register("multilabel", "mlp")
def _mlp_with_stop(data: DataFrame, size: int, classes: int, params: dict):
    """Neural student with early stopping: train in short runs, each continuing from the last weights,
    until the validation loss has not improved for ``patience`` runs; the best weights are kept. The search's memory
    goes from run to run."""
    settings = {"hidden": BINARY_HIDDEN, "step": 10, "max_runs": 50, "patience": PATIENCE} | params
    layers = [size, *settings.pop("hidden"), 2]
    step, runs, patience = settings.pop("step"), settings.pop("max_runs"), settings.pop("patience")
    train, held_out = (kept(packed(sparse_rows(data.filter(c)))) for c in ("not is_validation", "is_validation"))
    estimator, memory = _perceptron(layers, {"maxIter": step} | settings), Memory()
    best, best_loss, stale, weights, history = None, float("inf"), 0, None, []
    try:
        for _ in range(runs):
            before = weights
            weights, _ = fit_weights(estimator, train, weights, memory)
            if before is not None and weights is before:  # no later run moves them either
                break
            total, n, _ = loss_sums(held_out, layers, weights, gradient=False)
            loss = total / n if n else None
            history.append(loss)
            if best is None or loss is None or loss < best_loss:
                best, best_loss, stale = weights, loss if loss is not None else best_loss, 0
            else:
                stale += 1
            if loss is None or stale >= patience:
                break
    finally:
        train.unpersist()
        held_out.unpersist()
    return network(estimator, best), history


def _spread(data: DataFrame, partitions: int | None) -> DataFrame:
    """The feature table over even partitions: a core's share each, but no fewer than ``partitions``, none below or above some rows.

    A small file is read by one task, and a few partitions keep as many cores busy in every iteration.
    """
    if not partitions:
        return data
    rows, cores = data.count(), data.sparkSession.sparkContext.defaultParallelism
    wanted = max(min(cores, rows // LEAST_ROWS), rows // MOST_ROWS, partitions)
    return data.repartition(wanted)


def _vector_size(model: PipelineModel) -> int:
    return len(model.stages[1].vocabulary)


def _prepared(
    train: DataFrame, task: str, labels: list[str] | None, max_features: int | None, row_id: str
) -> tuple[list[str], PipelineModel, DataFrame]:
    """Label list, feature transformer and the feature table ``(row_id, features, y…, is_validation)``."""
    if task == "multilabel":
        labels = labels or listed(individual_labels(train))
        coded = train.withColumn("ys", multi_hot(F.col("label").cast("string"), labels))
    else:
        if labels is not None:
            train = filter_labels(train, labels)
        index, coded, _ = encode_labels(train)
        labels = [str(x) for x in listed(index.orderBy("idx"))]
        coded = coded.withColumn("y", F.col("idx").cast("double")).drop("idx")
    if len(labels) < 2:
        raise ValueError(f"at least two labels are needed, found {labels}")
    default = feats.MAX_FEATURES_MULTICLASS if task == "multiclass" else feats.MAX_FEATURES
    vocab = feats.tfidf_fit(coded, max_features or default)
    model = feats.tfidf_model(vocab)
    y = "ys" if task == "multilabel" else "y"
    return labels, model, model.transform(coded).select(row_id, "features", y)


def fit(
    train: DataFrame,
    task: str,
    student: str,
    labels: list[str] | None = None,
    max_features: int | None = None,
    parallelism: int = 4,
    row_id: str = "row_id",
    partitions: int | None = None,
    **params,
) -> Student:
    """Train a student on ``(row_id, text, label)``.

    ``partitions`` is the least number over which the feature table is spread before the iterations, each of which is a
    job over all of its partitions; a larger table gets one for each core (see ``_spread``).

    Features are computed once and persisted for the iterations (spilling to disk; lost blocks are
    recomputed). Multi-label students fit one model per label; the driver only submits those jobs, and
    holds the optimiser's vectors of ``MOST_SEARCHES`` neural students at a time.
    """
    trainer = _trainer(task, student)
    labels, model, data = _prepared(train, task, labels, max_features, row_id)
    if student == "gbt":
        data = split_validation(data, 0.1, SEED, row_id)
    elif task == "multilabel" and student != "logreg":
        data = split_validation(data, 0.2, SEED, row_id)
    size = _vector_size(model)
    rows = _spread(data, partitions)
    if student != "mlp" or task == "multilabel":  # the other perceptrons pack the rows once and keep the blocks
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if task == "multilabel":
            if student == "logreg":
                params["rows"] = rows.count()  # once for all labels
            jobs = [rows.withColumn("y", F.col("ys")[i].cast("double")) for i in range(len(labels))]
            with ThreadPool(min(MOST_SEARCHES if student == "mlp" else parallelism, len(labels))) as pool:
                fitted = pool.map(lambda d: trainer(d, size, 2, dict(params)), jobs)
        else:
            fitted = [trainer(rows, size, len(labels), dict(params))]
    finally:
        rows.unpersist()
    return Student(task, student, labels, model, [m for m, _ in fitted], [h for _, h in fitted])


def _probabilities(student: Student, df: DataFrame) -> DataFrame:
    """Add ``_p``: one probability per label."""
    out = student.features.transform(df).drop("_tokens", "_tf", "_weighted")
    if student.task != "multilabel":
        scored = student.models[0].transform(out)
        return scored.withColumn("_p", vector_to_array("probability")).drop("features", "rawPrediction", "probability")
    for i, model in enumerate(student.models):
        model = model.copy({model.predictionCol: f"_y{i}", model.rawPredictionCol: f"_r{i}", model.probabilityCol: f"_q{i}"})
        out = model.transform(out).withColumn(f"_p{i}", _class_probability(1, f"_q{i}")).drop(f"_y{i}", f"_r{i}", f"_q{i}")
    n = len(student.models)
    return out.withColumn("_p", F.array(*[F.col(f"_p{i}") for i in range(n)])).drop("features", *[f"_p{i}" for i in range(n)])


def active_labels(labels: list[str], probs: Column, threshold: float = THRESHOLD, strict: bool = False) -> Column:
    """Array of the labels whose probability reaches the threshold."""
    names = F.array(*map(F.lit, labels))
    on = (lambda p: p > threshold) if strict else (lambda p: p >= threshold)
    pairs = F.arrays_zip(names.alias("l"), probs.alias("p"))
    return F.transform(F.filter(pairs, lambda x: on(x["p"])), lambda x: x["l"])


def project_scores(df: DataFrame, task: str, labels: list[str], threshold: float = THRESHOLD, probs: str = "_p") -> DataFrame:
    """Wide scores from an array of probabilities, by task.

    Binary: ``probability`` of the second label and ``predicted_label``. Multi-class: the most
    probable label. Multi-label: ``<label>_prob`` columns and the active labels joined by commas.
    """
    p = F.col(probs)
    kind = task.split("_")[0]
    if kind == "binary":
        second = p[1]
        return df.withColumn("probability", second).withColumn(
            "predicted_label", F.when(second >= threshold, labels[1]).otherwise(labels[0])
        ).drop(probs)
    if kind == "multiclass":
        best = F.array_position(p, F.array_max(p)).cast("int") - 1
        return df.withColumn("predicted_label", F.array(*map(F.lit, labels))[best]).withColumn(
            "probability", F.array_max(p)
        ).drop(probs)
    if kind != "multilabel":
        raise ValueError(f"unknown task {task!r}")
    wide = [p[i].alias(f"{l}_prob") for i, l in enumerate(labels)]
    return df.select("*", *wide, F.array_join(active_labels(labels, p, threshold), ",").alias("predicted_label")).drop(probs)


def score(student: Student, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score texts; the rows of ``df`` with probability and label columns added. Row-wise, no shuffle."""
    plain = _probabilities(student, df).drop("prediction")
    return project_scores(plain, student.task, student.labels, threshold)


def struct_scores(df: DataFrame, labels: list[str], threshold: float = THRESHOLD, probs: str = "_p") -> DataFrame:
    """Nested scores: ``predictions`` map and ``predicted_labels`` above (not at) the threshold."""
    names = F.array(*map(F.lit, labels))
    return df.withColumn("predictions", F.map_from_arrays(names, probs)).withColumn(
        "predicted_labels", active_labels(labels, F.col(probs), threshold, strict=True)
    ).drop(probs)


def predict_struct(student: Student, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Nested scoring result per text."""
    return struct_scores(_probabilities(student, df).drop("prediction"), student.labels, threshold)


def inference(student: Student, threshold: float = THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    """Reusable scoring function over tables with a ``text`` column."""
    return lambda df: predict_struct(student, df, threshold)


_MODEL_TYPES = {
    "logreg": LogisticRegressionModel,
    "gbt": GBTClassificationModel,
    "mlp": MultilayerPerceptronClassificationModel,
}


def save_model(student: Student, path: str, spark) -> None:
    """Write features, models and labels below ``path``."""
    student.features.write().overwrite().save(f"{path}/features")
    for i, model in enumerate(student.models):
        model.write().overwrite().save(f"{path}/model_{i}")
    rows = [(student.task, student.name, i, l) for i, l in enumerate(student.labels)]
    meta = spark.createDataFrame(rows, "task string, student string, idx int, label string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


def load_model(spark, path: str) -> Student:
    """Read a student written by :func:`save_model`."""
    rows = spark.read.parquet(f"{path}/labels").orderBy("idx").collect()
    task, name = rows[0]["task"], rows[0]["student"]
    count = len(rows) if task == "multilabel" else 1
    models = [_MODEL_TYPES[name].load(f"{path}/model_{i}") for i in range(count)]
    return Student(task, name, [r["label"] for r in rows], PipelineModel.load(f"{path}/features"), models)


def cross_validate(
    train: DataFrame,
    test: DataFrame | None,
    student: str = "gbt",
    task: str = "binary",
    k: int = 5,
    max_features: int | None = None,
    row_id: str = "row_id",
    partitions: int | None = None,
    parallelism: int = 5,
    **params,
) -> DataFrame:
    """Accuracy per stratified fold of train and test together: ``(fold, accuracy, n_rows)``, and the mean as fold null.

    Features come from the training table alone. The row ids of both tables must differ.
    """
    trainer = _trainer(task, student)
    labels, model, _ = _prepared(train, task, None, max_features, row_id)
    rows = train if test is None else train.unionByName(test)
    index, coded, _ = encode_labels(rows)
    data = model.transform(coded).select(row_id, "features", F.col("idx").cast("double").alias("y"))
    data = stratified_folds(data, k, SEED, "y", row_id)
    if student == "gbt":
        # A seed of its own: folds are runs in hash order, so the same order would put all of these rows in one fold.
        data = split_validation(data, 0.1, SEED + 1, row_id)
    size = _vector_size(model)
    data = _spread(data, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def judged(fold: int) -> tuple[int, float, int]:
            fitted, _ = trainer(data.filter(F.col("fold") != fold), size, len(labels), dict(params))
            scored = fitted.transform(data.filter(F.col("fold") == fold))
            row = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.count("*")).first()
            return fold, row[0], row[1]

        # Folds of trees go side by side; the driver holds the vectors of one neural student at a time.
        with ThreadPool(1 if student == "mlp" else min(parallelism, k)) as pool:
            scores = pool.map(judged, range(k), 1)
    finally:
        data.unpersist()
    table = rows.sparkSession.createDataFrame(scores, "fold int, accuracy double, n_rows bigint")
    mean = table.agg(F.lit(None).cast("int").alias("fold"), F.avg("accuracy").alias("accuracy"), F.sum("n_rows").alias("n_rows"))
    return table.unionByName(mean)


def run(
    train: DataFrame, test: DataFrame | None, task: str, student: str, **options
) -> tuple[Student, DataFrame]:
    """Train, score and report in long form ``(section, name, precision, recall, f1, support)``.

    Sections are ``train`` and ``test`` (accuracy in the three value columns), ``report`` (per class, on
    the test table) and ``objective`` (one row per model and iteration). Without a test table the
    training table is the test table, and the section says so.
    """
    fitted = fit(train, task, student, **options)
    evaluated = train if test is None else test
    section = "test" if test is not None else "test_is_train"

    def acc(df: DataFrame, name: str) -> DataFrame:
        hit = F.avg(is_correct(F.col("label").cast("string"), F.col("predicted_label")).cast("double"))
        scored = score(fitted, df).agg(hit.alias("a"), F.count("*").alias("support"))
        return scored.select(
            F.lit(name).alias("section"), F.lit("accuracy").alias("name"),
            F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support",
        )

    report = classification_report(score(fitted, evaluated)).select(
        F.lit("report").alias("section"), F.col("class").alias("name"), "precision", "recall", "f1", "support"
    )
    points = [
        ("objective", f"{m}:{i}", float(v), float(v), float(v), 0) for m, h in enumerate(fitted.history) for i, v in enumerate(h)
    ]
    schema = "section string, name string, precision double, recall double, f1 double, support bigint"
    history = train.sparkSession.createDataFrame(points, schema)
    return fitted, acc(train, "train").unionByName(acc(evaluated, section)).unionByName(report).unionByName(history)
