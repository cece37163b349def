"""Ordinals, quantiles and joins, with hot keys and on the paths for large tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import ranking


def _skewed(spark, n=6000):
    """A third of the rows share one key, another third is NULL."""
    rnd = random.Random(1)
    rows = [
        (i, 5.0 if i % 3 == 0 else None if i % 3 == 1 else round(rnd.uniform(0, 10), 3),
         "hot" if i % 3 else f"g{i % 50}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, v double, g string")


def test_ordinal_with_hot_and_missing_values(spark):
    df = _skewed(spark)
    got = {r["id"]: r["position"] for r in ranking.with_ordinal(df, "v", ["id"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["v"] is not None, r["v"] or 0.0, r["id"]))
    assert got == {r["id"]: i for i, r in enumerate(rows, start=1)}


def test_ordinal_spreads_equal_rows(spark, monkeypatch):
    """One row repeated: every range gets its share."""
    stored, write = [], ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, stem: stored.append(write(df, stem)) or stored[-1])
    df = spark.range(40_000).select(F.lit("same").alias("s"), F.lit(1.5).alias("v"))
    numbered = ranking.with_ordinal(df.repartition(4), "v", ["s"], parts=8)
    assert sorted(r["position"] for r in numbered.select("position").collect()) == list(range(1, 40_001))
    sizes = [r["count"] for r in stored[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_split_points_find_hot_values(spark):
    cuts = ranking.split_points(_skewed(spark), "v", 64)
    assert cuts.count(5.0) > 1 and None in cuts


def test_ordinal_without_ties_is_a_permutation(spark):
    df = spark.createDataFrame([("a",)] * 500 + [("b",)] * 3, "s string")
    got = sorted(r["position"] for r in ranking.with_ordinal(df, "s").collect())
    assert got == list(range(1, 504))


def test_bucketed_row_number_equals_plain(spark):
    df = spark.range(2000).select(
        F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 2003).alias("x")
    )
    got = ranking.bucketed_row_number(df, ["k"], F.floor(F.col("x") / 100), [F.col("x")])
    want = df.selectExpr("*", "cast(row_number() over (partition by k order by x) as long) as position")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(spark, by):
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.normal(0, 1, 40000), np.full(20000, 0.25), rnd.exponential(9, 5000)])
    keys = np.where(np.arange(values.size) % 3 == 0, "hot", "other")
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, values)], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ranking.quantiles(df.repartition(5), ["v"], probs, by).collect()
    assert len(got) == (2 if by else 1)
    for r in got:
        mine = values[keys == r["g"]] if by else values
        assert r["n"] == mine.size
        np.testing.assert_allclose([r[f"q{j}"] for j in range(5)], np.quantile(mine, probs), rtol=1e-12)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    row = ranking.quantiles(df, ["x"], [0.5]).first()
    assert (row["n"], row["q0"]) == (2, 2.5)


def test_ordered_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 7e200, np.inf])
    bits = ranking.ordered_bits(x)
    assert (bits[:-1] <= bits[1:]).all() and bits[4] == bits[5] and len(set(bits)) == len(x) - 1
    assert (ranking.number_of(bits) == x).all()


@pytest.mark.parametrize("gathered", [0, 10, 50_000])
def test_quantiles_of_hot_close_and_extreme_values(spark, monkeypatch, gathered):
    """Every bit is needed, values repeat over half of the rows, columns have gaps."""
    monkeypatch.setattr(ranking, "GATHERED", gathered)
    rnd = np.random.default_rng(5)
    close = 1.0 + rnd.integers(0, 50, 3000) * 2.0**-52
    hot = np.where(rnd.random(3000) < 0.6, 7.25, rnd.normal(0, 1e-3, 3000))
    wide = np.concatenate([[np.inf, -np.inf, 0.0, -0.0], 10.0 ** rnd.uniform(-300, 300, 2996) * rnd.choice([-1, 1], 2996)])
    rows = [(float(a), float(b) if i % 5 else None, float(c), None, i) for i, (a, b, c) in enumerate(zip(close, hot, wide))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e long").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {r["column"]: r for r in ranking.quantiles(df, ["a", "b", "c", "d", "e"], probs).collect()}
    assert "d" not in got and got["b"]["n"] == 2400
    for name, want in (("a", close), ("b", hot[np.arange(3000) % 5 != 0]), ("e", np.arange(3000.0))):
        np.testing.assert_allclose([got[name][f"q{j}"] for j in range(6)], np.quantile(want, probs), rtol=1e-15)
    assert got["c"]["q0"] == -np.inf and got["c"]["q5"] == np.inf
    assert got["c"]["q3"] == np.quantile(wide, 0.5)


def test_quantiles_of_groups_with_missing_and_nested_keys(spark):
    rnd = np.random.default_rng(6)
    rows = [(None if i % 3 == 0 else i % 4, "x" if i % 2 else None, float(np.round(rnd.normal(), 2)) if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, s string, v double").unionByName(spark.createDataFrame([(9, "none", None)], "k int, s string, v double"))
    got = {(r["k"], r["s"]): [r["n"], r["q0"], r["q1"]] for r in ranking.quantiles(df, ["v"], [0.1, 0.5], ["k", "s"]).collect()}
    want = {}
    for k, s, v in rows:
        if v is not None:
            want.setdefault((k, s), []).append(v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(got[key], [len(values), *np.quantile(values, [0.1, 0.5])], rtol=1e-12)


def test_quantile_plans_move_counts_and_not_values(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("v0"))
    counts = ranking._bin_counts(df, {0: np.zeros(1, dtype=np.uint64)}, 0, ranking.LEADING_BITS)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("limit", ["-1", "10MB"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_paths_agree(spark, limit, how):
    df = _skewed(spark, 600)
    small = spark.createDataFrame([("hot", 1), ("g0", 2), (None, 3)], "g string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        joined = ranking.lookup_join(df, small, ["g"], how)
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == (limit != "-1")
        got = joined.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = df.join(small, "g", how).select(joined.columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))


def test_lookup_join_matches_missing_keys(spark):
    df = spark.createDataFrame([(None, 1)], "k string, x int")
    small = spark.createDataFrame([(None, 7)], "k string, w int")
    assert ranking.lookup_join(df, small, ["k"]).first()["w"] == 7


def test_top_k_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    top = ranking.top_k_per_group(df, ["g"], [F.col("id").desc()], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_rows_with_maps_can_be_ordered_and_joined(spark):
    df = spark.sql("select id, map('a', id) as m, id % 2 as k from range(10)")
    assert sorted(r["position"] for r in ranking.with_ordinal(df, "k").collect()) == list(range(1, 11))
    small = spark.createDataFrame([(0, "even")], "k long, name string")
    assert ranking.lookup_join(df, small, ["k"]).count() == 5


def test_quantiles_of_rows_that_stand_for_others(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, float("nan"), -2.0, 0.0, rnd.gauss(0, 5)]), rnd.randint(1, 9)) for _ in range(300)]
    few = spark.createDataFrame(rows, "v double, n long")
    every = few.select("v", F.explode(F.expr("sequence(1, n)"))).drop("col")
    for kept in (ranking.GATHERED, 0):
        monkeypatch.setattr(ranking, "GATHERED", kept)
        got = ranking.quantiles(few, ["v"], [0.0, 0.31, 0.5, 1.0], rows="n").first()
        assert got == ranking.quantiles(every, ["v"], [0.0, 0.31, 0.5, 1.0]).first()
