"""Multinomial logistic regression over feature arrays, one model per level.

Rows are ``(id, <vec> ARRAY<DOUBLE>, label)``.
"""

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hierspark.operators.reduce import with_features
from hierspark.operators.scores import union_all

# Default iteration limit of the solver.
MAX_ITER = 100
TOLERANCE = 1e-6


def class_counts(rows: DataFrame, label: str = "label") -> list[tuple[int, int]]:
    """``(label, rows)`` in numeric order, as many as the model has classes."""
    return sorted((r[0], r[1]) for r in rows.groupBy(label).count().collect())


def fit(
    rows: DataFrame,
    vec: str = "vec",
    label: str = "label",
    c: float = 1.0,
    max_iter: int = MAX_ITER,
    tol: float = TOLERANCE,
    counts: Sequence[tuple[int, int]] | None = None,
) -> PipelineModel:
    """L2-penalised fit; ``c`` weighs the summed loss against half the squared weights.

    ``convergence`` tells whether the solver stopped before ``max_iter``, ``gradient`` how far the result is from
    the optimum.  ``counts`` are the class counts of the rows where the caller has them already.
    """
    counts = class_counts(rows, label) if counts is None else counts
    data = with_features(rows, vec).select("features", F.col(label).cast("string").alias("label"))
    index = StringIndexerModel.from_labels([str(x) for x, _ in counts], inputCol="label", outputCol="_y")
    regression = LogisticRegression(
        family="multinomial",
        regParam=1.0 / (c * sum(n for _, n in counts)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
        labelCol="_y",
    ).fit(index.transform(data))
    return PipelineModel([index, regression])


def convergence(model: PipelineModel) -> tuple[int, bool]:
    """Iterations of a fresh fit, and whether it converged within its limit."""
    regression = model.stages[1]
    steps = regression.summary.totalIterations
    return steps, steps < regression.getMaxIter()


def gradient(rows: DataFrame, model: PipelineModel, vec: str = "vec", label: str = "label") -> DataFrame:
    """``(label, n_rows, norm)``: Euclidean norm of the penalised mean loss's gradient in the weights of each class.

    The loss is convex, so a small norm over the rows of the fit certifies the fit, whatever solver made it.  One
    aggregate makes it: every row adds its features times (probability - truth) to each class, combined before the
    shuffle.  A row whose label the model does not know counts as false for every class.
    """
    regression = model.stages[1]
    penalty = F.lit(regression.getRegParam())
    weights = np.asarray(regression.coefficientMatrix.toArray())
    known = F.array(*[F.array(*map(F.lit, row.tolist())) for row in weights])
    residual = F.col("_p") - (F.col("_label") == F.col("_truth")).cast("double")
    rated = predict(rows, model, vec).select(F.col(vec).alias("_x"), F.col(label).cast("bigint").alias("_truth"), F.posexplode("probs").alias("_k", "_p"))
    placed = rated.withColumn("_label", F.element_at(_labels(model), F.col("_k") + 1)).withColumn("_r", F.coalesce(residual, F.col("_p")))
    # the constant 1 stands for the intercept, which is not penalised
    steps = array_to_vector(F.transform(F.concat("_x", F.array(F.lit(1.0))), lambda x: x * F.col("_r")))
    mean = placed.groupBy("_k", "_label").agg(F.count(F.lit(1)).alias("n_rows"), Summarizer.mean(steps).alias("_mean"))
    pull = F.concat(F.transform(F.element_at(known, F.col("_k") + 1), lambda w: w * penalty), F.array(F.lit(0.0)))
    total = F.zip_with(vector_to_array("_mean"), pull, lambda a, b: a + b)
    square = F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x)
    return mean.select(F.col("_label").alias("label"), "n_rows", F.sqrt(square).alias("norm"))


def _labels(model: PipelineModel):
    return F.array(*[F.lit(int(x)).cast("bigint") for x in model.stages[0].labels])


def predict(rows: DataFrame, model: PipelineModel, vec: str = "vec") -> DataFrame:
    """Add ``pred_label`` and the array ``probs`` in class order."""
    out = model.stages[1].transform(with_features(rows, vec))
    return out.withColumns(
        {
            "probs": vector_to_array("probability"),
            "pred_label": F.element_at(_labels(model), F.col("prediction").cast("int") + 1),
        }
    ).drop("features", "rawPrediction", "probability", "prediction")


def score(rows: DataFrame, model: PipelineModel, lvl: int, vec: str = "vec") -> DataFrame:
    """Long ``scores(id, lvl, label, ord, prob)`` with every class of the model."""
    return (
        predict(rows, model, vec)
        .select("id", F.posexplode("probs").alias("ord", "prob"))
        .select(
            "id", F.lit(lvl).alias("lvl"), F.element_at(_labels(model), F.col("ord") + 1).alias("label"), "ord", "prob"
        )
    )


def score_levels(rows: DataFrame, models: Mapping[int, PipelineModel], vec: str = "vec") -> DataFrame:
    return union_all([score(rows, model, lvl, vec) for lvl, model in sorted(models.items())])


def coefficients(spark, model: PipelineModel) -> DataFrame:
    """``(label, pos, weight)``; position -1 is the intercept."""
    regression = model.stages[1]
    weights = np.column_stack([regression.interceptVector.toArray(), regression.coefficientMatrix.toArray()])
    cells = [
        (int(label), pos - 1, float(w))
        for label, row in zip(model.stages[0].labels, weights)
        for pos, w in enumerate(row)
    ]
    return spark.createDataFrame(cells, "label BIGINT, pos INT, weight DOUBLE")


def stratified_folds(rows: DataFrame, k: int = 5, label: str = "label", key: str = "id", slices: int = 64) -> DataFrame:
    """Add ``fold``: within each label the rows are dealt out in turn, so fold sizes differ by at most one.

    Rows are numbered inside hashed slices of their label and shifted by the sizes of the
    slices before, so a label with very many rows is numbered by many tasks.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    before = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(label, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(label, "_slice").orderBy(key)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [label, "_slice"])
        .withColumn("fold", ((F.col("_offset") + F.col("_rn")) % k).cast("int"))
        .select(*rows.columns, "fold")
    )


def cross_validate(folded: DataFrame, vec: str = "vec", label: str = "label", c: float = 1.0, parallelism: int = 4) -> list[float]:
    """Accuracy on each fold of a model fitted on the others.

    Classes of all folds are counted in one pass; up to ``parallelism`` folds are fitted at the same time.
    """
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)

    def one(f: int) -> float:
        rest = {}
        for fold, value, n in sizes:
            if fold != f:
                rest[value] = rest.get(value, 0) + n
        model = fit(folded.filter(F.col("fold") != f), vec, label, c, counts=sorted(rest.items()))
        return accuracy(folded.filter(F.col("fold") == f), model, vec, label)

    try:
        # one row for each class and fold, as many as the models have classes
        sizes = [tuple(r) for r in folded.groupBy("fold", label).count().collect()]
        folds = sorted({fold for fold, _, _ in sizes})
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            return list(pool.map(inheritable_thread_target(folded.sparkSession)(one), folds))
    finally:
        folded.unpersist()


def cv_report(spark, accuracies: list[float], validation: float | None = None) -> DataFrame:
    """One row: folds, mean accuracy, population deviation, accuracy on the validation table."""
    a = np.asarray(accuracies)
    row = [(len(accuracies), float(a.mean()), float(a.std()), validation)]
    return spark.createDataFrame(row, "n_folds INT, acc_mean DOUBLE, acc_std DOUBLE, validation_acc DOUBLE")


def accuracy(rows: DataFrame, model: PipelineModel, vec: str = "vec", label: str = "label") -> float:
    hit = (F.col("pred_label") == F.col(label)).cast("double")
    return predict(rows, model, vec).agg(F.avg(hit)).first()[0]
