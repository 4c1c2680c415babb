"""Principal components of wide vectors without their covariance matrix.

A random block is multiplied by the cross-products of the standardised rows, ``Z'Z Q``, in one pass over the rows; what is
new in the product is the next block.  The leading eigenvectors are sought in the span of all blocks (block Krylov).  A pass
brings one number for each feature and column of the block to the driver, and partial products are summed before their
shuffle.  The blocks together stay far below the width where the variances fall off; where they do not, the
search ends at the latest when the blocks span the space.

The error of a component is at most about its residual divided by its distance from the next eigenvalue; the search goes on
until that is below ``tol``, so the components are those of the covariance matrix and not an approximation of chance.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.operators.reduce import fit_standardiser


@dataclass(frozen=True)
class Components:
    """Means and factors of the standardiser, loadings (width x k, each largest one positive), shares of the variance."""

    mean: np.ndarray
    factor: np.ndarray
    loadings: np.ndarray
    ratio: np.ndarray
    passes: int


def _standard(batch: pa.RecordBatch, at: int, mean: np.ndarray, factor: np.ndarray) -> np.ndarray:
    values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (values.reshape(batch.num_rows, len(mean)) - mean) * factor


def cross_products(rows: DataFrame, mean: np.ndarray, factor: np.ndarray, block: np.ndarray, vec: str = "vec") -> tuple[np.ndarray, float]:
    """``Z'Z block`` and the sum of squares of ``Z``."""
    width, m = block.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((width, m)), 0.0
        for batch in batches:
            if batch.num_rows:
                z = _standard(batch, 0, mean, factor)
                total += z.T @ (z @ block)
                squares += float((z * z).sum())
        if squares:
            cells = np.vstack([total, np.full((1, m), squares)])
            offsets = pa.array(np.arange(width + 2, dtype=np.int32) * m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], names=["pos", "part"])

    parts = rows.select(vec).mapInArrow(partial, "pos INT, part ARRAY<DOUBLE>")
    summed = parts.groupBy("pos").agg(Summarizer.sum(array_to_vector(F.col("part"))).alias("part"))
    out = np.zeros((width + 1, m))
    for r in summed.collect():
        out[r["pos"]] = r["part"].toArray()
    return out[:width], float(out[width, 0])


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, values, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, values > 1e-10]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0][:, : basis.shape[0] - basis.shape[1]] if left.size else left


def fit(rows: DataFrame, k: int, vec: str = "vec", extra: int = 16, tol: float = 1e-7, max_passes: int = 100, seed: int = 5) -> Components:
    """The ``k`` leading components; ``extra`` more columns a block make passes fewer."""
    scaler, fix = fit_standardiser(rows, vec).stages
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    factor = np.divide(fix.getScalingVec().toArray(), std, out=np.zeros_like(std), where=std > 0)
    width = len(mean)
    if not 0 < k <= width:
        raise ValueError(f"{k} components of {width} features")
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + extra))))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for passes in range(1, max_passes + 1):
        product, squares = cross_products(rows, mean, factor, block, vec)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        inner = basis.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        found = basis @ turns[:, :k]
        residual = np.linalg.norm(image @ turns[:, :k] - found * values[:k], axis=0)
        distance = np.abs(values[:k, None] - values[None, :])
        distance[np.arange(k), np.arange(k)] = np.inf
        block = _fresh(product, basis)
        if (residual <= np.maximum(tol * distance.min(axis=1), 1e-13 * max(values[0], 0.0))).all() or not block.size:
            largest = found[np.abs(found).argmax(axis=0), np.arange(k)]
            return Components(mean, factor, found * np.where(largest < 0, -1.0, 1.0), values[:k] / squares if squares else values[:k] * 0, passes)
    raise RuntimeError(f"components not found after {max_passes} passes")


def project(rows: DataFrame, fitted: Components, vec: str = "vec") -> DataFrame:
    """Add the array ``pc``; a NULL vector has NULL there."""
    schema = T.StructType([*rows.schema.fields, T.StructField("pc", T.ArrayType(T.DoubleType()))])
    at, (mean, factor, loadings) = rows.columns.index(vec), (fitted.mean, fitted.factor, fitted.loadings)
    k = loadings.shape[1]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(at).is_valid()
            values = _standard(batch.filter(known), at, mean, factor) @ loadings
            ends = np.append(0, np.cumsum(known.to_numpy(zero_copy_only=False))) * k
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(~known.to_numpy(zero_copy_only=False), False)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=schema.names)

    return rows.mapInArrow(projected, schema)


def residuals(rows: DataFrame, fitted: Components, vec: str = "vec") -> DataFrame:
    """``(component, n_rows, residual)`` from one aggregate over the rows: how far each component is from an eigenvector, as a
    share of its eigenvalue."""
    product, squares = cross_products(rows, fitted.mean, fitted.factor, fitted.loadings, vec)
    values = fitted.ratio * squares
    norms = np.linalg.norm(product - fitted.loadings * values, axis=0) / np.where(values > 0, values, 1.0)
    n = rows.count()
    return rows.sparkSession.createDataFrame([(i, n, float(x)) for i, x in enumerate(norms)], "component INT, n_rows BIGINT, residual DOUBLE")
