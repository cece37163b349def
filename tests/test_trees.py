"""Histogram trees: closed forms, both ways of fitting, and what a model must reach."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlens.operators import trees


def _data(spark, n=600, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 2)), 1)
    z = rng.integers(0, 2, n)
    number = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5.0, 0.0) - 2 * z + rng.normal(0, 0.1, n)
    y = np.digitize(number, np.quantile(number, np.arange(1, classes) / classes)).astype(float) if classes else number
    rows = [([float(a), float(b), float(c)], float(t), k) for k, ((a, b), c, t) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "x array<double>, y double, id int").withColumn("features", array_to_vector("x"))
    return df, np.column_stack([x, z]), y


def _uses():
    return [F.lit(True), F.col("id") % 3 != 0]


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("kind", ["levels", "leaves", "residuals"])
def test_boosting_by_jobs_equals_boosting_in_a_task(spark, classes, kind):
    df, x, y = _data(spark, 300, classes)
    setting = {
        "levels": trees.Boosting(4, 0.3, trees.Growth(depth=4, columns=0.8), row_share=0.8),
        "leaves": trees.Boosting(4, 0.3, trees.Growth(depth=40, leaves=9, penalty=0.0, least_rows=5), balanced=True),
        "residuals": trees.Boosting(4, 0.3, trees.Growth(depth=3, penalty=0.0, least_hessian=0.0), by_rows=True),
    }[kind]
    fit = lambda size: trees.fit_all(df.repartition(3), "features", "y", 2, 3, classes, _uses(), setting, size)
    for here, there in zip(fit(1 << 20), fit(0)):
        np.testing.assert_allclose(here.scores(x), there.scores(x), rtol=1e-7, atol=1e-9)
        if kind == "leaves":
            assert max((np.asarray(t.column) < 0).sum() - _dead(t) for t in here.trees) <= 9


def _dead(tree):
    """Leaves that no path reaches."""
    column, left, right = np.asarray(tree.column), np.asarray(tree.left), np.asarray(tree.right)
    seen, todo = set(), [0]
    while todo:
        k = todo.pop()
        seen.add(k)
        if column[k] >= 0:
            todo += [left[k], right[k]]
    return sum(1 for k in range(len(column)) if column[k] < 0 and k not in seen)


def test_one_round_by_hand(spark):
    """One split: leaves are G / (H + 1), a class margin starts at the log odds."""
    df = spark.createDataFrame([([float(k)], 10.0 if k >= 5 else 0.0, k) for k in range(8)], "x array<double>, y double, id int").withColumn("features", array_to_vector("x"))
    one = trees.fit_all(df, "features", "y", 1, 1, 0, [F.lit(True)], trees.Boosting(1, 1.0, trees.Growth(depth=1)))[0]
    mean = 30 / 8
    want = [mean - 5 * mean / 6] * 5 + [mean + 3 * (10 - mean) / 4] * 3
    np.testing.assert_allclose(one.scores(np.arange(8.0)[:, None])[:, 0], want)
    labels = df.withColumn("y", (F.col("y") > 0).cast("double"))
    two = trees.fit_all(labels, "features", "y", 1, 1, 2, [F.lit(True)], trees.Boosting(1, 1.0, trees.Growth(depth=1, least_hessian=0.0)))[0]
    p = 3 / 8
    low = np.log(p / (1 - p)) - 5 * p / (5 * p * (1 - p) + 1)
    np.testing.assert_allclose(two.scores(np.zeros((1, 1)))[0, 1], 1 / (1 + np.exp(-low)))


def test_leaves_open_by_gain(spark):
    """The side with the larger gain is split twice before the other one once."""
    rows = [([float(k)], y, k) for k, y in enumerate([0.0, 1.0, 0.0, 1.0, 100.0, 200.0, 400.0, 800.0])]
    df = spark.createDataFrame(rows, "x array<double>, y double, id int").withColumn("features", array_to_vector("x"))
    growth = trees.Growth(depth=9, leaves=4, penalty=0.0, least_hessian=0.0)
    for size in (0, 1 << 20):
        one = trees.fit_all(df, "features", "y", 1, 1, 0, [F.lit(True)], trees.Boosting(1, 1.0, growth), size)[0]
        np.testing.assert_allclose(one.scores(np.arange(8.0)[:, None])[:, 0], [0.5] * 4 + [150.0] * 2 + [400.0, 800.0])


@pytest.mark.parametrize("classes", [0, 3])
def test_forests_grow_to_purity_in_both_ways(spark, classes):
    df, x, y = _data(spark, 400, classes)
    setting = trees.Forest(12, balanced=bool(classes), per_node=0)
    here = trees.fit_all(df.repartition(3), "features", "y", 2, 3, classes, _uses(), setting, 1 << 20)
    there = trees.fit_all(df.repartition(3), "features", "y", 2, 3, classes, _uses(), setting, 90 * 40)
    for a, b in zip(here, there):
        np.testing.assert_allclose(a.scores(x), b.scores(x), rtol=1e-7, atol=1e-9)
    found = here[0].scores(x)
    if classes:
        assert (found.argmax(axis=1) == y).mean() > 0.97 and np.allclose(found.sum(axis=1), 1)
    else:
        assert np.corrcoef(found[:, 0], y)[0, 1] > 0.98
    assert max(len(t.column) for t in here[0].trees) > 50


def test_a_chain_is_deeper_than_any_fixed_limit(spark):
    """Rows whose best split always cuts off one end."""
    rows = [([float(k)], float(3.0 ** k), k) for k in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y double, id int").withColumn("features", array_to_vector("x"))
    one = trees.fit_all(df, "features", "y", 1, 1, 0, [F.lit(True)], trees.Forest(1))[0]

    def depth(t, k=0):
        return 0 if t.column[k] < 0 else 1 + max(depth(t, t.left[k]), depth(t, t.right[k]))

    assert depth(one.trees[0]) >= 15


def test_models_see_their_own_rows_only(spark):
    """The second model never sees the rows that carry another target."""
    df = spark.createDataFrame([([float(k % 10)], 100.0 if k % 3 == 0 else 1.0, k) for k in range(300)], "x array<double>, y double, id int").withColumn("features", array_to_vector("x"))
    for setting in (trees.Boosting(3, 0.5, trees.Growth(depth=2)), trees.Forest(3)):
        found = trees.fit_all(df, "features", "y", 1, 1, 0, [F.lit(True), F.col("id") % 3 != 0], setting)
        assert np.allclose(found[1].scores(np.arange(10.0)[:, None]), 1.0)
        assert found[0].scores(np.arange(10.0)[:, None]).mean() > 10


def test_bootstrap_weights_have_the_moments_of_poisson():
    block = trees.Block(np.zeros((50_000, 1), np.uint8), np.repeat([[1.0], [20.0], [500.0]], [20_000, 20_000, 10_000], axis=0), None, None, trees._mixed(np.arange(50_000, dtype=np.uint64)))
    drawn = trees._drawn(block, 0, 3)
    for part, mean in ((drawn[:20_000], 1), (drawn[20_000:40_000], 20), (drawn[40_000:], 500)):
        assert part.mean() == pytest.approx(mean, rel=0.03) and part.var() == pytest.approx(mean, rel=0.1)


def test_importance_and_scores_of_a_table(spark):
    df, x, y = _data(spark, 300, 3)
    one = trees.fit_all(df, "features", "y", 2, 3, 3, [F.lit(True)], trees.Boosting(5, 0.3, trees.Growth(depth=3)))[0]
    rows = trees.scored(df, "features", one, "p").orderBy("id").collect()
    np.testing.assert_allclose([r["p"] for r in rows], one.scores(x))
    found = trees.importances(one.trees, 3)
    assert found.sum() == pytest.approx(1.0) and found[0] == found.max()


def test_cuts_of_rows_that_stand_for_others(spark):
    rng = np.random.default_rng(9)
    x, n = np.round(rng.normal(size=2000), 2), rng.integers(1, 20, 2000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, n)], "x double, n long").repartition(3)
    cuts = trees.bins_of(df, [F.col("x")], 1, 50, "n").cuts[0]
    held = np.sort(np.repeat(x, n))
    want = np.unique([held[max(0, int(np.ceil(k * len(held) / 50)) - 1)] for k in range(50)])
    np.testing.assert_array_equal(cuts, want)


def test_thinned_values_keep_their_ranks(monkeypatch):
    monkeypatch.setattr(trees, "POINTS", 40)
    rng = np.random.default_rng(2)
    x, n = np.append(rng.normal(size=3000), np.nan), np.append(rng.integers(1, 5, 3000), 1).astype(float)
    n[17] = 2000.0  # one value holds a fifth of the rows
    v, w = trees._thinned(x, n)
    total = n[:-1].sum()
    assert len(v) <= 2 * 40 and w.sum() == total and (np.diff(v) > 0).all() and (w > 0).all()
    order = np.argsort(x[:-1])
    upto = dict(zip(x[order], np.cumsum(n[order])))
    assert all(upto[a] == b for a, b in zip(v, np.cumsum(w)))
    others = np.diff(np.cumsum(w), prepend=0)[v != x[17]]
    assert others.max() <= total / 40 + 4
