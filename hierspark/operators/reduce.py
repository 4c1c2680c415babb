"""Standardise feature vectors and project them on principal components.

Rows are ``(id, vec ARRAY<DOUBLE>, …)``.  A fitted reducer is a ``PipelineModel`` of built-in
stages, so it is saved and loaded like any other model.  What a fit brings to the driver
depends on the width of the vectors only.
"""

import math

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_features(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vec)))


def fit_standardiser(rows: DataFrame, vec: str = "vec") -> PipelineModel:
    """Zero mean and unit *population* deviation; a constant column becomes 0.

    The built-in scaler divides by the sample deviation, the second stage corrects that.
    """
    features = with_features(rows, vec).select("features")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_std").fit(features)
    n = features.count()
    fix = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    stage = ElementwiseProduct(scalingVec=Vectors.dense([fix] * len(scaler.mean)), inputCol="_std", outputCol="z")
    return PipelineModel([scaler, stage])


def standardise(rows: DataFrame, model: PipelineModel | None = None, vec: str = "vec") -> DataFrame:
    """Add the vector ``z``.  Without a model the statistics are those of ``rows`` itself."""
    model = model or fit_standardiser(rows, vec)
    return model.transform(with_features(rows, vec)).drop("features", "_std")


def fit(rows: DataFrame, k: int, vec: str = "vec") -> PipelineModel:
    """Standardiser, ``k`` principal components, and signs that make each largest loading positive."""
    scale = fit_standardiser(rows, vec)
    z = scale.transform(with_features(rows, vec)).select("z")
    pca = PCA(k=k, inputCol="z", outputCol="_pc").fit(z)
    loadings = pca.pc.toArray()
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    signs = ElementwiseProduct(
        scalingVec=Vectors.dense(np.where(largest < 0, -1.0, 1.0)), inputCol="_pc", outputCol="pc"
    )
    return PipelineModel([*scale.stages, pca, signs])


def project(rows: DataFrame, model: PipelineModel, fit_scale: str = "model", vec: str = "vec") -> DataFrame:
    """Add the array ``pc``.

    ``fit_scale="self"`` standardises the rows by their own statistics before the saved
    projection, ``"model"`` uses the statistics of the fitted table.
    """
    if fit_scale not in ("self", "model"):
        raise ValueError(f"unknown fit_scale: {fit_scale}")
    scale = PipelineModel(model.stages[:2]) if fit_scale == "model" else fit_standardiser(rows, vec)
    out = PipelineModel([*scale.stages, *model.stages[2:]]).transform(with_features(rows, vec))
    return out.withColumn("pc", vector_to_array("pc")).drop("features", "_std", "z", "_pc")


def loadings(model: PipelineModel) -> np.ndarray:
    """Loadings with fixed signs, one column per component."""
    return model.stages[2].pc.toArray() * model.stages[3].getScalingVec().toArray()


def loadings_table(spark, model: PipelineModel) -> DataFrame:
    cells = [(int(c), int(p), float(v)) for (p, c), v in np.ndenumerate(loadings(model))]
    return spark.createDataFrame(cells, "component INT, pos INT, loading DOUBLE")


def variance_table(spark, model: PipelineModel) -> DataFrame:
    """Share of the total variance per component."""
    cells = [(i, float(v)) for i, v in enumerate(model.stages[2].explainedVariance.toArray())]
    return spark.createDataFrame(cells, "component INT, ratio DOUBLE")
