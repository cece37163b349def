import numpy as np
import pandas as pd
from pyspark.sql import functions as F
import pytest

from gridlens.operators import chartdata, insights, profile


def test_empty_table_has_no_percentage(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = profile.missing_values(df).collect()
    assert [(r["column"], r["missing"], r["missing_percent"]) for r in rows] == [("a", 0, None), ("b", 0, None)]
    assert profile.numeric_summary(df.select("a")).first()["mean"] is None


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    assert profile.missing_values(df).first()["missing"] == 2
    row = profile.numeric_summary(df).first()
    assert (row["mean"], row["median"], row["max"]) == (2.5, 2.5, 4.0)


def test_duplicates_count_missing_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (2, 1), (2, 1), (3, None)], "a int, b int")
    assert profile.duplicate_rows(df).first()[0] == 3


def test_duplicates_of_nested_values(spark):
    df = spark.sql("select array(1, 2) as a, map('x', id % 2) as m from range(6)")
    assert profile.duplicate_rows(df).first()[0] == 4


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0), (2.0, 3.0, 4.0), (4.0, 3.0, None)], "a double, k double, b double")
    r = {(x["col_i"], x["col_j"]): x["r"] for x in profile.correlation(df).collect()}
    assert r["a", "k"] is None and r["k", "k"] is None
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "a"] == pytest.approx(1.0)
    assert len(r) == 9


def test_correlation_in_several_passes(spark, monkeypatch):
    df = spark.sql("select id as a, id * id as b, id % 3 as c, -id as d from range(50)")
    whole = sorted(profile.correlation(df).collect())
    monkeypatch.setattr(profile, "CORRELATION_COLUMNS", 2)
    parts = sorted(profile.correlation(df).collect())
    assert [x[:2] for x in whole] == [x[:2] for x in parts]
    assert [x[2] for x in whole] == pytest.approx([x[2] for x in parts])


def test_correlation_of_many_columns_with_gaps(spark):
    """200 columns, gaps that differ, constants: pandas' pairwise r, from two scans."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 3))
    x = base @ rng.normal(size=(3, 200)) + rng.normal(0, 0.3, (150, 200)) + rng.normal(0, 50, 200)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 9] = 4.2, np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    got = profile.correlation(spark.createDataFrame(frame)).toPandas().pivot(index="col_i", columns="col_j", values="r")
    want = frame.corr().loc[got.index, got.columns]
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), atol=1e-9)
    assert got.loc["c7"].isna().all() and got.loc["c9"].isna().all()


def test_one_numeric_column_cannot_correlate(spark):
    with pytest.raises(ValueError):
        profile.correlation(spark.range(3))


def test_task_of_text_and_numbers(spark):
    df = spark.sql("select id, id % 20 as few, cast(id as string) as s, cast(id % 21 as double) as more from range(500)")
    tasks = {r["column"]: r["task"] for r in profile.detect_task_type(df).collect()}
    assert tasks == {"id": "regression", "few": "classification", "s": "classification", "more": "regression"}


def test_describe_puts_both_kinds_together(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "n int, s string")
    rows = {r["column"]: r for r in profile.describe(df).collect()}
    assert rows["s"]["top"] == "a" and rows["s"]["mean"] is None
    assert rows["n"]["q50"] == 2.0 and rows["n"]["unique"] is None


def test_describe_covers_booleans_and_dates(spark):
    df = spark.sql("select id % 3 = 0 as flag, date_add(date'2024-01-01', cast(id as int)) as day, array(id) as a from range(7)")
    rows = {r["column"]: r for r in profile.describe(df).collect()}
    assert (rows["flag"]["count"], rows["flag"]["top"], rows["flag"]["freq"], rows["flag"]["unique"]) == (7, "false", 4, 2)
    assert (rows["day"]["count"], rows["day"]["first"], rows["day"]["last"]) == (7, "2024-01-01", "2024-01-07")
    assert set(rows) == {"flag", "day"}


def test_group_mean_drops_missing_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in chartdata.group_mean(df, "g", "v").collect()] == [("a", 1.0), ("b", None)]


def test_histogram_of_constant_and_empty(spark):
    rows = chartdata.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 5).collect()
    assert sum(r["count"] for r in rows) == 4 and len(rows) == 5
    assert chartdata.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_box_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4, 100]], "x double")
    r = chartdata.box_stats(df, "x").first()
    assert (r["q1"], r["median"], r["q3"], r["outliers"], r["whisker_high"]) == (2.0, 3.0, 4.0, 1, 4.0)


def test_metric_bands(spark):
    df = spark.createDataFrame([("cv_mean", 0.3), ("big", 10.0), ("none", None)], "metric string, value double")
    rows = {r["metric"]: r for r in chartdata.metrics_bands(df).collect()}
    assert rows["cv_mean"]["title"] == "Cv Mean" and rows["cv_mean"]["band"] == "low"
    assert rows["big"]["gauge_max"] == 12.0 and rows["big"]["band"] == "high" and "none" not in rows
    assert [(rows[m]["position"], rows[m]["primary"]) for m in ("cv_mean", "big")] == [(1, True), (2, False)]
    placed = df.select("metric", "value", F.when(F.col("metric") == "big", 3).otherwise(9).alias("position"))
    assert [r["metric"] for r in chartdata.metrics_bands(placed).where("primary").collect()] == ["big"]


def test_trends_without_a_task_of_all_periods(spark):
    """Second grain over a gap: changes to the period before, slope over the period number."""
    rows = [(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i * i)) for i in range(0, 600, 2)] + [("2024-01-01 00:00:00", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = sorted(insights.trends(df, "t", "v", "second").collect(), key=lambda r: r["period"])
    totals = [float(i * i) for i in range(0, 600, 2)]
    assert [r["total"] for r in got] == totals and got[0]["change"] is None
    assert [r["change"] for r in got[1:]] == [b - a for a, b in zip(totals, totals[1:])]
    assert got[0]["slope"] == pytest.approx(np.polyfit(range(300), totals, 1)[0])
    assert insights.trends(df.limit(0), "t", "v").count() == 0


def test_anomalies_of_whole_table(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(1000.0,)], "x double")
    found = insights.anomalies(df, "x").collect()
    assert [r["x"] for r in found] == [1000.0] and found[0]["extreme_z"]
