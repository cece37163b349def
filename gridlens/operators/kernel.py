"""Support vectors with the RBF kernel, by random Fourier features (Rahimi and Recht, 2007).

A feature is the cosine of a random projection; the projections follow from a seed
and are made where they are used.  Rows with equal values and target are one cell
that carries its number of rows for every model.  A model is found by L-BFGS, which
only asks for the loss and its gradient at a point: as for trees, cells that fit a
task are sent to one task per model, and beyond that a Spark job per step adds up
the losses of all models.

Classes: hinge loss for every pair of classes, a sigmoid per pair (Platt, 1999), and
the probabilities that fit all pairs best (Wu, Lin and Weng, 2004).  Numbers: loss
beyond a distance of EPSILON.  The corner of a loss is rounded over a width of SOFT.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators.trees import run_together
from gridlens.session import materialise

EPSILON, COST, SOFT = 0.1, 1.0, 0.05
MEMORY = 8
TASK_BYTES = 96 << 20


def fourier(rows: np.ndarray, gamma: float, size: int, seed: int) -> np.ndarray:
    """Features whose products are about exp(-gamma * squared distance), and a constant."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=np.sqrt(2 * gamma), size=(rows.shape[1], size))
    phase = rng.uniform(0, 2 * np.pi, size=size)
    return np.column_stack([np.sqrt(2.0 / size) * np.cos(rows @ directions + phase), np.ones(len(rows))])


@dataclass
class Cells:
    x: np.ndarray
    y: np.ndarray
    rows: np.ndarray


def cells_of(df: DataFrame, features: str, label: str, uses: Sequence[Any], rows: str | None = None) -> DataFrame:
    """Stored (x, y, rows): distinct rows and how many of them each model sees; `rows` says how many rows each stands for."""
    picked = df.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(rows) if rows else F.lit(1)).cast("double").alias("n"),
        *[F.coalesce(u, F.lit(False)).alias(f"u{m}") for m, u in enumerate(uses)],
    )
    counted = picked.groupBy("x", "y").agg(F.array(*[F.coalesce(F.sum(F.when(F.col(f"u{m}"), F.col("n"))), F.lit(0.0)) for m in range(len(uses))]).alias("rows"))
    return materialise(counted, "kernel-cells")


def as_cells(rows: Any) -> Cells:
    frame = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame([tuple(r) for r in rows], columns=["x", "y", "rows"])
    return Cells(np.array(frame["x"].tolist(), dtype=np.float64), frame["y"].to_numpy(dtype=np.float64), np.array(frame["rows"].tolist(), dtype=np.float64))


@dataclass(frozen=True)
class Problem:
    """A pair of classes of one model, or its numbers (no pair); weights of the two classes and rows in all."""

    model: int
    pair: tuple[int, int] | None
    weights: tuple[float, float]
    total: float


def softened(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, distance) with a rounded corner, and its slope."""
    slope = np.clip(distance / SOFT, 0.0, 1.0)
    return np.where(distance < SOFT, 0.5 * slope * np.maximum(distance, 0.0), distance - 0.5 * SOFT), slope


def loss_sums(z: np.ndarray, cells: Cells, problem: Problem, kind: str, point: Any) -> np.ndarray:
    """Loss and gradient (one array) at a point, summed over the cells."""
    rows = cells.rows[:, problem.model]
    if problem.pair is None:
        error = cells.y - z @ point
        value, slope = softened(np.abs(error) - EPSILON)
        return np.concatenate([[(rows * value).sum()], z.T @ (-rows * slope * np.sign(error))])
    low, high = problem.pair
    inside = (cells.y == low) | (cells.y == high)
    z, rows, truth = z[inside], rows[inside], cells.y[inside] == high
    if kind == "margin":
        sign = np.where(truth, 1.0, -1.0)
        weighted = rows * np.where(truth, problem.weights[1], problem.weights[0])
        value, slope = softened(1 - sign * (z @ point))
        return np.concatenate([[(weighted * value).sum()], z.T @ (-weighted * slope * sign)])
    weights, sigmoid, targets = point
    margin = z @ weights
    aim = np.where(truth, targets[1], targets[0])
    odds = sigmoid[0] * margin + sigmoid[1]
    value = np.logaddexp(0, odds) - aim * odds
    left = rows * (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - aim)
    return np.array([(rows * value).sum(), (left * margin).sum(), left.sum()])


def lbfgs(start: np.ndarray, ask: Callable[[np.ndarray], Any], iterations: int, tolerance: float = 1e-6) -> Generator:
    """Least value of a function: yields points, is sent (value, gradient), returns the best point."""
    x, (value, slope) = start, (yield ask(start))
    steps, turns = [], []
    for _ in range(iterations):
        if np.abs(slope).max() <= tolerance * max(1.0, np.abs(x).max()):
            break
        q, factors = slope.copy(), []
        for s, t in zip(reversed(steps), reversed(turns)):
            a = (s @ q) / (s @ t)
            factors.append(a)
            q -= a * t
        q *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if steps else 1.0 / max(1.0, np.linalg.norm(slope))
        for (s, t), a in zip(zip(steps, turns), reversed(factors)):
            q += (a - (t @ q) / (s @ t)) * s
        down = -(slope @ q)
        if down >= 0:
            q, down, steps, turns = slope.copy(), -(slope @ slope), [], []
        size = 1.0
        for _ in range(30):
            new_value, new_slope = yield ask(x - size * q)
            if new_value <= value + 1e-4 * size * down:
                break
            size *= 0.5
        else:
            break
        s, t = -size * q, new_slope - slope
        x, value, slope = x + s, new_value, new_slope
        if s @ t > 1e-12:
            steps, turns = [*steps[1 - MEMORY :], s], [*turns[1 - MEMORY :], t]
    return x


def solve(problem: Problem, counts: tuple[float, float], size: int, iterations: int) -> Generator:
    """The weights of a problem, and its sigmoid; asks for loss sums."""
    penalty = np.append(np.full(size, 1.0 / (COST * problem.total)), 0.0)

    def fitting(start: np.ndarray, kind: str, extra: Callable, cost: np.ndarray | float) -> Generator:
        found = lbfgs(start, lambda x: x, iterations)
        point = next(found)
        while True:
            sums = yield problem, kind, extra(point)
            value, slope = sums[0] / problem.total, sums[1:] / problem.total
            try:
                point = found.send((value + 0.5 * (cost * point * point).sum(), slope + cost * point))
            except StopIteration as done:
                return done.value

    weights = yield from fitting(np.zeros(size + 1), "margin", lambda x: x, penalty)
    if problem.pair is None:
        return weights, None
    targets = (1.0 / (counts[0] + 2.0), (counts[1] + 1.0) / (counts[1] + 2.0))
    start = np.array([1.0, np.log((counts[1] + 1.0) / (counts[0] + 1.0))])
    sigmoid = yield from fitting(start, "sigmoid", lambda x: (weights, x, targets), 1e-12)
    return weights, sigmoid


def problems_of(model: int, counts: np.ndarray, classes: int) -> list[tuple[Problem, tuple[float, float]]]:
    """Pairs of the classes, weighted so that all classes count the same; counts: rows per class, or in all."""
    if not classes:
        return [(Problem(model, None, (1.0, 1.0), max(counts.sum(), 1.0)), (0.0, 0.0))]
    held = np.maximum(counts, 1.0)
    weights = counts.sum() / (max(1, (counts > 0).sum()) * held)
    return [
        (Problem(model, (i, j), (weights[i], weights[j]), max(counts[i] + counts[j], 1.0)), (counts[i], counts[j]))
        for i, j in combinations(range(classes), 2)
    ]


def coupled(r: np.ndarray) -> np.ndarray:
    """Probabilities of k classes from r[..., i, j], the probability of i where it is i or j: least squares under sum 1."""
    k = r.shape[-1]
    system = np.zeros((len(r), k + 1, k + 1))
    system[:, :k, :k] = -np.swapaxes(r, 1, 2) * r
    for i in range(k):
        others = [j for j in range(k) if j != i]
        system[:, i, i] = (r[:, others, i] ** 2).sum(axis=1)
    system[:, :k, k] = system[:, k, :k] = 1.0
    right = np.zeros((len(r), k + 1, 1))
    right[:, k] = 1.0
    p = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0.0, None)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class KernelModel:
    gamma: float
    size: int
    seed: int
    classes: int
    parts: list[tuple[np.ndarray, np.ndarray | None]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or numbers in one column."""
        z = fourier(rows, self.gamma, self.size, self.seed)
        if not self.classes:
            return (z @ self.parts[0][0])[:, None]
        if self.classes == 1:
            return np.ones((len(rows), 1))
        r = np.full((len(rows), self.classes, self.classes), 0.5)
        for (i, j), (weights, sigmoid) in zip(combinations(range(self.classes), 2), self.parts):
            odds = np.clip(sigmoid[0] * (z @ weights) + sigmoid[1], -16, 16)
            r[:, j, i] = 1 / (1 + np.exp(-odds))
            r[:, i, j] = 1 - r[:, j, i]
        return np.stack([r[:, 0, 1], r[:, 1, 0]], axis=1) if self.classes == 2 else coupled(r)


def _counts(cells: Cells, model: int, classes: int) -> np.ndarray:
    rows = cells.rows[:, model]
    return np.bincount(cells.y.astype(np.int64), rows, minlength=classes) if classes else np.array([rows.sum()])


def fit_all(
    df: DataFrame, features: str, label: str, classes: int, uses: Sequence[Any], gamma: float, size: int = 200,
    iterations: int = 100, seed: int = 42, task_bytes: int | None = None, rows: str | None = None,
) -> list[KernelModel]:
    """One model per row filter in `uses`, all from the same cells."""
    spark = df.sparkSession
    cells = cells_of(df, features, label, uses, rows)
    width = len(df.select(vector_to_array(features)).first()[0])
    per_cell = 8 * (width + size + 2 + len(uses))
    task_bytes = TASK_BYTES if task_bytes is None else task_bytes
    models = range(len(uses))
    if cells.limit(task_bytes // per_cell + 1).count() * per_cell <= task_bytes:
        shared = spark.sparkContext.broadcast(as_cells(cells.toPandas()))

        def fit(batches):
            for batch in batches:
                found = []
                for model in batch["model"]:
                    held = shared.value
                    z = fourier(held.x, gamma, size, seed)
                    problems = problems_of(int(model), _counts(held, int(model), classes), classes)
                    ask = lambda asked, z=z, held=held: [loss_sums(z, held, *request) for _, *request in asked]
                    found.append(pickle.dumps(run_together([solve(p, c, size, iterations) for p, c in problems], ask)))
                yield pd.DataFrame({"model": batch["model"], "parts": found})

        work = spark.createDataFrame([(m,) for m in models], "model int").repartition(len(uses), "model")
        found = work.mapInPandas(fit, "model int, parts binary").collect()
        parts = {r["model"]: pickle.loads(bytes(r["parts"])) for r in found}
    else:
        held = cells.rdd.mapPartitions(_whole).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = held.map(lambda b: [_counts(b, m, classes) for m in models]).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
            every = [pc for m in models for pc in problems_of(m, counts[m], classes)]

            def ask(asked: list) -> list:
                requests = [request for _, *request in asked]

                def one(block: Cells) -> list:
                    z = fourier(block.x, gamma, size, seed)
                    return [loss_sums(z, block, *request) for request in requests]

                return held.map(one).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])

            solved = run_together([solve(p, c, size, iterations) for p, c in every], ask)
            parts = {m: [s for (p, _), s in zip(every, solved) if p.model == m] for m in models}
        finally:
            held.unpersist()
    return [KernelModel(gamma, size, seed, classes, parts[m]) for m in models]


def _whole(rows):
    held = list(rows)
    if held:
        yield as_cells(held)
