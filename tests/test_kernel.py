"""Support vectors: least losses, hand-solved couplings, both ways of fitting."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlens.operators import kernel, linear


def _data(spark, classes, n=240):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, 2)), 1)
    radius = (x**2).sum(axis=1)
    y = np.digitize(radius, np.quantile(radius, np.arange(1, classes) / classes)).astype(float) if classes else np.sin(x[:, 0]) * 3
    rows = [([float(a), float(b)], float(t), k) for k, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "x array<double>, y double, id int").withColumn("features", array_to_vector("x")), x, y


def test_coupling_recovers_consistent_probabilities():
    """Pairs that come from one set of probabilities give them back; three classes by hand."""
    for p in (np.array([0.2, 0.8]), np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])):
        r = p[:, None] / (p[:, None] + p[None, :])
        np.testing.assert_allclose(kernel.coupled(r[None])[0], p, rtol=1e-9)
    even = np.full((1, 3, 3), 0.5)
    np.testing.assert_allclose(kernel.coupled(even)[0], [1 / 3] * 3)


def test_softened_loss_and_its_slope():
    at = np.linspace(-1, 1, 2001)
    value, slope = kernel.softened(at)
    assert (value[at <= 0] == 0).all() and (slope[at > kernel.SOFT + 1e-9] == 1).all()
    np.testing.assert_allclose(np.gradient(value, at)[1:-1], slope[1:-1], atol=2e-2)
    np.testing.assert_allclose(value, np.maximum(at, 0), atol=kernel.SOFT)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_both_ways_of_fitting_agree(spark, classes):
    df, x, y = _data(spark, classes)
    uses = lambda: [F.lit(True), F.col("id") % 4 != 0]
    fit = lambda size: kernel.fit_all(df.repartition(3), "features", "y", classes, uses(), 0.5, 40, 25, task_bytes=size)
    here, there = fit(1 << 24), fit(0)
    for a, b in zip(here, there):
        np.testing.assert_allclose(a.scores(x), b.scores(x), atol=2e-2)
    found = here[0].scores(x)
    if classes:
        assert (found.argmax(axis=1) == y).mean() > 0.85 and np.allclose(found.sum(axis=1), 1)
    else:
        assert np.mean(np.abs(found[:, 0] - y) < 3 * kernel.EPSILON) > 0.8


def test_no_direction_lowers_the_loss(spark):
    df, x, y = _data(spark, 0)
    one = kernel.fit_all(df, "features", "y", 0, [F.lit(True)], 0.5, 20, 400)[0]
    cells = kernel.Cells(x, y, np.ones((len(x), 1)))
    problem = kernel.Problem(0, None, (1.0, 1.0), float(len(x)))
    z = kernel.fourier(x, 0.5, 20, 42)

    def cost(w):
        return kernel.loss_sums(z, cells, problem, "margin", w)[0] / len(x) + 0.5 * (w[:-1] ** 2).sum() / len(x)

    weights, rng = one.parts[0][0], np.random.default_rng(0)
    best = cost(weights)
    assert all(cost(weights + step * rng.normal(size=len(weights))) >= best - 1e-6 for step in (1e-3, 1e-2, 1e-1) for _ in range(50))


def test_fourier_products_are_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    z = kernel.fourier(x, 0.4, 20_000, 7)[:, :-1]
    want = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(z @ z.T, want, atol=0.05)


def test_lasso_and_ridge_against_their_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.2, 1] + [0, 3, 1, 0]
    x[:, 3] = 2.0  # constant
    y = x[:, 0] - 0.3 * x[:, 1] + rng.normal(0, 0.1, 500) + 4
    full = np.column_stack([x, np.ones(500), y])
    standard = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    one = linear.lasso(full.T @ full, 0.05)
    weights = one.coefficients.toArray() * np.where(x.std(0) > 0, x.std(0), 1)
    error = y - (x @ one.coefficients.toArray() + one.intercept)
    slopes = standard.T @ error / 500
    assert abs(error.mean()) < 1e-9 and weights[3] == 0
    for w, s in zip(weights, slopes):
        assert abs(s - 0.05 * np.sign(w)) < 1e-6 if w else abs(s) <= 0.05 + 1e-9
    two = linear.ridge(full.T @ full, 7.0)
    want = np.linalg.solve(standard[:, :3].T @ standard[:, :3] + 7 * np.eye(3), standard[:, :3].T @ (y - y.mean()))
    np.testing.assert_allclose(two.coefficients.toArray()[:3] * x.std(0)[:3], want, rtol=1e-8)
