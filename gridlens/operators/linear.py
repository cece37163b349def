"""Ridge and lasso for all folds from one pass.

The products of all pairs of columns are summed once per model (the final one and
one per fold).  A model then follows from its matrix alone, whatever the number of
rows: its own means and deviations, the ridge by solving, the lasso by coordinate
descent on the covariances.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.operators.gram import summed_matrices


@dataclass
class LinearModel:
    """A prediction is the product of features and coefficients, plus the intercept."""

    coefficients: DenseVector
    intercept: float

    def predict(self, features: str) -> Column:
        weights = F.lit(self.coefficients.toArray().tolist())
        terms = F.zip_with(vector_to_array(features), weights, lambda x, w: x * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.lit(self.intercept)


def moments(df: DataFrame, features: str, label: str, uses: Sequence[Column], rows: str | None = None) -> list[np.ndarray]:
    """Per row filter the sums of products of (features..., 1, target); `rows` says how many rows each stands for."""
    flags = [f"u{m}" for m in range(len(uses))]
    picked = df.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(rows) if rows else F.lit(1)).cast("double").alias("n"),
        *[F.coalesce(u, F.lit(False)).alias(name) for name, u in zip(flags, uses)],
    )

    def products(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        full = np.column_stack([x, np.ones(len(x)), batch.column("y").to_numpy()])
        out = {}
        for m, name in enumerate(flags):
            inside = batch.column(name).to_numpy(zero_copy_only=False)
            own = full[inside]
            out[m] = own.T @ (own * batch.column("n").to_numpy()[inside, None])
        return out

    found = summed_matrices(picked, products)
    return [found[m] for m in range(len(uses))]


def _standard(products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Covariances of the scaled features, those with the target, means, deviations, mean target and rows."""
    n = products[-2, -2]
    mean = products[:-2, -2] / n
    target = products[-1, -2] / n
    cov = products[:-2, :-2] / n - np.outer(mean, mean)
    to_target = products[:-2, -1] / n - mean * target
    deviation = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # a column without variance within this model's rows
    flat = deviation <= 1e-9 * np.sqrt(np.maximum(np.diag(products)[:-2] / n, 1e-300))
    deviation = np.where(flat, 1.0, deviation)
    cov = np.where(flat[:, None] | flat[None, :], 0.0, cov / np.outer(deviation, deviation))
    return cov, np.where(flat, 0.0, to_target / deviation), mean, deviation, target, n


def _model(weights: np.ndarray, mean: np.ndarray, deviation: np.ndarray, target: float) -> LinearModel:
    own = weights / deviation
    return LinearModel(DenseVector(own), float(target - own @ mean))


def ridge(products: np.ndarray, alpha: float) -> LinearModel:
    """Least squares plus alpha times the squared weights of the scaled features."""
    cov, to_target, mean, deviation, target, n = _standard(products)
    weights = np.linalg.solve(cov + alpha / n * np.eye(len(cov)), to_target) if alpha else np.linalg.lstsq(cov, to_target)[0]
    return _model(weights, mean, deviation, target)


def lasso(products: np.ndarray, alpha: float, iterations: int = 5000, tolerance: float = 1e-10) -> LinearModel:
    """Half the mean squared error plus alpha times the absolute weights of the scaled features."""
    cov, to_target, mean, deviation, target, _ = _standard(products)
    weights = np.zeros(len(cov))
    left = to_target.copy()  # covariances with what is not explained yet
    scale = max(float(np.abs(to_target).max(initial=0.0)), 1e-300)
    for _ in range(iterations):
        moved = 0.0
        for j in range(len(weights)):
            if cov[j, j] <= 0:
                continue
            free = left[j] + cov[j, j] * weights[j]
            new = np.sign(free) * max(abs(free) - alpha, 0.0) / cov[j, j]
            if new != weights[j]:
                left -= cov[:, j] * (new - weights[j])
                moved, weights[j] = max(moved, abs(new - weights[j])), new
        if moved <= tolerance * scale:
            break
    return _model(weights, mean, deviation, target)


def fit_all(df: DataFrame, features: str, label: str, uses: Sequence[Any], name: str, alpha: float = 1.0, iterations: int = 5000, rows: str | None = None) -> list[LinearModel]:
    """One model per row filter in `uses`."""
    return [ridge(m, alpha) if name == "ridge" else lasso(m, alpha, iterations) for m in moments(df, features, label, uses, rows)]
