"""Chart data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import chartdata as chart
from gridlens.operators import evaluate
from gridlens.plans.registry import EVENTS_MISSING, PRICE_PREDICTIONS, Tables, query, rounded


@query(
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin,
      count(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 30), 4) AS low,
      round(lo + (b.bin + 1) * ((hi - lo) / 30), 4) AS high, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin"""
)
def histogram(t: Tables) -> DataFrame:
    return rounded(chart.histogram(t.orders, "o_totalprice"))


@query(
    f"""SELECT event_type, round(avg(value), 4) AS mean FROM {EVENTS_MISSING}
    WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def group_mean(t: Tables) -> DataFrame:
    return rounded(chart.group_mean(t.events_missing, "event_type", "value"))


@query("SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def scatter_points(t: Tables) -> DataFrame:
    return chart.scatter(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
      max(l_extendedprice) AS y1 FROM lineitem)
    SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 50)), 49) AS INTEGER) AS x_bin,
      CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 50)), 49) AS INTEGER) AS y_bin,
      l_returnflag AS color, count(*) AS count FROM lineitem, e GROUP BY 1, 2, 3"""
)
def scatter_bins(t: Tables) -> DataFrame:
    return chart.scatter_bins(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
    f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_fence,
      q3 + 1.5::DOUBLE * (q3 - q1) AS upper_fence FROM q)
    SELECT e.event_type, count(*) AS count, round(any_value(q1), 4) AS q1,
      round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
      round(any_value(lower_fence), 4) AS lower_fence, round(any_value(upper_fence), 4) AS upper_fence,
      min(value) FILTER (WHERE value BETWEEN lower_fence AND upper_fence) AS whisker_low,
      max(value) FILTER (WHERE value BETWEEN lower_fence AND upper_fence) AS whisker_high,
      count(*) FILTER (WHERE NOT value BETWEEN lower_fence AND upper_fence) AS outliers
    FROM events e JOIN f ON e.event_type = f.event_type GROUP BY e.event_type"""
)
def box_stats(t: Tables) -> DataFrame:
    return rounded(chart.box_stats(t.events, "value", "event_type"))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS ordinal, value FROM events")
def line_ordinal(t: Tables) -> DataFrame:
    return chart.line(t.events, "value", "ts", ["event_id"])


@query(
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period,
      round(avg(o_totalprice), 4) AS value, count(*) AS n FROM orders GROUP BY 1"""
)
def time_series(t: Tables) -> DataFrame:
    months = chart.time_series(t.orders, "o_orderdate", "o_totalprice", "month")
    return rounded(months.withColumn("period", F.date_format("period", "yyyy-MM-dd")))


@query(f"SELECT o_totalprice AS actual, predicted FROM {PRICE_PREDICTIONS}")
def actual_vs_predicted(t: Tables) -> DataFrame:
    return chart.actual_vs_predicted(t.price_predictions, "o_totalprice", "predicted")


@query(
    f"""SELECT least(min(o_totalprice), min(predicted)) AS low,
      greatest(max(o_totalprice), max(predicted)) AS high FROM {PRICE_PREDICTIONS}"""
)
def fit_line_bounds(t: Tables) -> DataFrame:
    return chart.fit_line_bounds(t.price_predictions, "o_totalprice", "predicted")


@query("SELECT lang AS type, count(*) AS count FROM documents GROUP BY lang")
def type_counts(t: Tables) -> DataFrame:
    return chart.type_counts(t.documents, "lang")


@query(
    f"""WITH m AS (SELECT avg((o_totalprice - predicted) ** 2) AS mse,
      avg(abs(o_totalprice - predicted)) AS mae, var_pop(o_totalprice) AS v FROM {PRICE_PREDICTIONS}),
    l AS (SELECT unnest(['rmse', 'mae', 'r2_score']) AS metric,
      unnest([sqrt(mse), mae, 1 - mse / v]) AS value FROM m),
    g AS (SELECT *, CASE WHEN value <= 1 THEN 1.0 ELSE value * 1.2::DOUBLE END AS gauge_max FROM l)
    SELECT CAST(CASE metric WHEN 'rmse' THEN 1 WHEN 'mae' THEN 2 ELSE 3 END AS INTEGER) AS position,
      metric = 'rmse' AS "primary", metric, CASE metric WHEN 'rmse' THEN 'Rmse' WHEN 'mae' THEN 'Mae' ELSE 'R2 Score' END AS title,
      round(value, 3) AS value, round(gauge_max, 3) AS gauge_max,
      CASE WHEN value < 0.5 * gauge_max THEN 'low' WHEN value < 0.8 * gauge_max THEN 'middle'
      ELSE 'high' END AS band FROM g"""
)
def metrics_bands(t: Tables) -> DataFrame:
    one_row = evaluate.regression_metrics(t.price_predictions, "o_totalprice", "predicted")
    long = one_row.select(
        F.expr("stack(3, 'rmse', rmse, 'mae', mae, 'r2_score', r2_score)").alias("metric", "value")
    )
    return rounded(chart.metrics_bands(long), 3)
