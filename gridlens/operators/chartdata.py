"""The aggregates behind charts; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.columns import nan_to_null, quoted
from gridlens.operators.ranking import lookup_join, quantiles, with_ordinal


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count): equal widths, right edge of the last bin closed,
    empty bins included.  Infinite values have no bin and are left out."""
    values = nan_to_null(df.select(quoted(column).cast("double").alias("x"))).where("abs(x) < double('inf')")
    edges = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if edges["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    lo, width = edges["lo"], (edges["hi"] - edges["lo"]) / bins
    place = (
        F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        if width > 0 else F.lit(0)
    )
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def group_mean(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, mean) ordered by category; missing categories are dropped."""
    clean = nan_to_null(df.select(quoted(category), quoted(value)))
    return (
        clean.where(quoted(category).isNotNull())
        .groupBy(quoted(category))
        .agg(F.avg(quoted(value)).alias("mean"))
        .orderBy(quoted(category))
    )


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """All points."""
    cols = [quoted(x).alias("x"), quoted(y).alias("y")]
    return df.select(*cols, *([quoted(color).alias("color")] if color else []))


def scatter_bins(
    df: DataFrame, x: str, y: str, color: str | None = None, bins: int = 50
) -> DataFrame:
    """Point counts on a bins x bins grid: a scatter plot whose size does not
    grow with the table."""
    cols = [quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y")]
    keys = ["x_bin", "y_bin"]
    if color:
        cols.append(quoted(color).alias("color"))
        keys.append("color")
    pts = nan_to_null(df.select(*cols)).where("x is not null and y is not null")
    e = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def place(c: str, lo: float | None, hi: float | None) -> Column:
        if lo is None or hi <= lo:
            return F.lit(0)
        w = (hi - lo) / bins
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")

    return (
        pts.withColumn("x_bin", place("x", e["x0"], e["x1"]))
        .withColumn("y_bin", place("y", e["y0"], e["y1"]))
        .groupBy(*keys)
        .agg(F.count("*").alias("count"))
    )


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Quartiles, Tukey fences, whiskers inside them and the number of outliers."""
    by = [group] if group else []
    clean = nan_to_null(
        df.select(*[quoted(g) for g in by], quoted(value).cast("double").alias("_x"))
    ).where("_x is not null")
    fences = tukey_fences(clean, "_x", by)
    joined = lookup_join(clean, fences.drop("n"), by) if by else _with_one_row(clean, fences.drop("n"))
    inside = F.col("_x").between(F.col("lower_fence"), F.col("upper_fence"))
    same = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    return (
        joined.groupBy(*[quoted(g) for g in by])
        .agg(
            F.count("*").alias("count"),
            *[F.first(c).alias(c) for c in same],
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def tukey_fences(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, q1, median, q3, lower_fence, upper_fence)."""
    q = quantiles(df, [value], [0.25, 0.5, 0.75], by)
    iqr = F.col("q2") - F.col("q0")
    return q.select(
        *[quoted(b) for b in by],
        "n",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        (F.col("q0") - 1.5 * iqr).alias("lower_fence"),
        (F.col("q2") + 1.5 * iqr).alias("upper_fence"),
    )


def _with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    row = one_row.first()
    values = row.asDict() if row else dict.fromkeys(one_row.columns)
    return df.select("*", *[F.lit(v).alias(k) for k, v in values.items()])


def line(df: DataFrame, value: str, order_by: str, ties: Sequence[str] = ()) -> DataFrame:
    """(ordinal, value): a column over its row number in a stated order."""
    numbered = with_ordinal(
        df.select(*dict.fromkeys([order_by, *ties, value])), order_by, ties, "ordinal"
    )
    return numbered.select("ordinal", quoted(value).alias("value"))


def time_series(
    df: DataFrame, date: str, value: str, grain: str | None = None, how: str = "avg"
) -> DataFrame:
    """(period, value, n) by truncated date, or the raw points without a grain."""
    clean = nan_to_null(df.select(quoted(date), quoted(value)))
    if grain is None:
        return clean.select(quoted(date).alias("period"), quoted(value).alias("value")).orderBy(
            "period"
        )
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    return (
        clean.groupBy(F.date_trunc(grain, quoted(date)).alias("period"))
        .agg(agg(quoted(value)).alias("value"), F.count("*").alias("n"))
        .orderBy("period")
    )


def actual_vs_predicted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.select(quoted(label).alias("actual"), quoted(prediction).alias("predicted"))


def fit_line_bounds(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (low, high): the span of the perfect-fit line."""
    return df.agg(
        F.least(F.min(quoted(label)), F.min(quoted(prediction))).alias("low"),
        F.greatest(F.max(quoted(label)), F.max(quoted(prediction))).alias("high"),
    )


def type_counts(df: DataFrame, column: str) -> DataFrame:
    """(type, count) for a pie or bar chart."""
    return df.groupBy(quoted(column).alias("type")).agg(F.count("*").alias("count"))


def metrics_bands(metrics: DataFrame) -> DataFrame:
    """Dashboard rows from a long (metric, value) table in display order, or in that of
    its ``position``; the first metric with a number is the primary one.

    The gauge ends at 1, or at 1.2 times the value when that is above 1; its
    bands break at 0.5 and 0.8 of the end.  Rows without a number are dropped.
    """
    title = F.initcap(F.replace(F.col("metric"), F.lit("_"), F.lit(" ")))
    end = F.when(F.col("value") <= 1, F.lit(1.0)).otherwise(F.col("value") * 1.2)
    kept = metrics.where("value is not null")
    order = F.col("position") if "position" in metrics.columns else F.monotonically_increasing_id()
    # a dashboard has few metrics
    place = F.row_number().over(Window.orderBy("_order"))
    return (
        kept.withColumn("_order", order)
        .withColumn("gauge_max", end)
        .select(
            place.alias("position"),
            (place == 1).alias("primary"),
            "metric",
            title.alias("title"),
            "value",
            "gauge_max",
            F.when(F.col("value") < 0.5 * F.col("gauge_max"), "low")
            .when(F.col("value") < 0.8 * F.col("gauge_max"), "middle")
            .otherwise("high")
            .alias("band"),
        )
    )
