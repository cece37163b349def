"""Table profile: size, missing values, duplicates, summaries, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.columns import (
    boolean_columns,
    categorical_columns,
    is_missing,
    nan_to_null,
    numeric_columns,
    quoted,
    require_columns,
    temporal_columns,
    type_class,
)
from gridlens.operators.gram import summed_matrices
from gridlens.operators.ranking import quantiles

CLASSIFICATION_MAX_VALUES = 20
CORRELATION_COLUMNS = 500


def _rows(cells: Sequence[Column]) -> Column:
    return F.explode(F.array(*cells)).alias("r")


def table_size(df: DataFrame) -> DataFrame:
    """One row: row_count, features."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "features", F.lit(len(df.columns)).cast("long")
    )


def column_types(df: DataFrame) -> DataFrame:
    """(ordinal, column, type, type_class), from the schema alone."""
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), type_class(f.dataType))
        for i, f in enumerate(df.schema)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, type string, type_class string"
    )


def _missing_counts(df: DataFrame) -> DataFrame:
    """One row: n, and the missing cells m0, m1, ... of each column."""
    return df.agg(
        F.count("*").alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def _missing_percent(i: int) -> Column:
    return F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")), 2)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing, missing_percent) in one pass; percent is NULL without rows."""
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
            _missing_percent(i).alias("missing_percent"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _missing_counts(df).select(_rows(cells)).select("r.*")


def column_overview(df: DataFrame) -> DataFrame:
    """Types of the columns beside their missing cells."""
    return column_types(df).join(missing_values(df), "column").select(
        "ordinal", "column", "type", "type_class", "missing", "missing_percent"
    )


def columns_with_missing(df: DataFrame) -> DataFrame:
    return missing_values(df).where("missing > 0")


def total_missing(df: DataFrame) -> DataFrame:
    return missing_values(df).agg(F.sum("missing").alias("total_missing"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier one (missing equals missing).

    Rows are compared by two 64-bit hashes of all their values, counted before
    they move: sixteen bytes per distinct row and task, and no hot row.
    """
    comparable = nan_to_null(df).select(
        *[
            F.to_json(quoted(f.name)).alias(f"c{i}") if "map<" in f.dataType.simpleString()
            else quoted(f.name).alias(f"c{i}")
            for i, f in enumerate(df.schema)
        ]
    )
    names = comparable.columns
    # a null leaves the hash unchanged, so the place of nulls is hashed as well
    nulls = F.concat(F.lit(""), *[F.col(c).isNull().cast("int").cast("string") for c in names])
    hashed = comparable.select(F.xxhash64(nulls, *names).alias("a"), F.xxhash64(*names, nulls, F.lit(1)).alias("b"))
    groups = hashed.groupBy("a", "b").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, mean, std, min, max, median) per numeric column."""
    columns = list(numeric_columns(df) if columns is None else columns)
    require_columns(df, columns)
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, std double, min double, max double, median double"
        )
    aggs = [
        F.struct(
            F.lit(c).alias("column"),
            F.round(F.avg(quoted(c)), 4).alias("mean"),
            F.round(F.stddev_samp(quoted(c)), 4).alias("std"),
            F.min(quoted(c)).cast("double").alias("min"),
            F.max(quoted(c)).cast("double").alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    wide = clean.agg(*aggs)
    basic = wide.select(_rows([F.col(f"s{i}") for i in range(len(columns))])).select("r.*")
    medians = quantiles(clean, columns, [0.5]).select("column", F.col("q0").alias("median"))
    return basic.join(medians, "column", "left")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max)."""
    columns = list(numeric_columns(df) if columns is None else columns)
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    wide = clean.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(quoted(c)).alias("count"),
                F.avg(quoted(c)).alias("mean"),
                F.stddev_samp(quoted(c)).alias("std"),
                F.min(quoted(c)).cast("double").alias("min"),
                F.max(quoted(c)).cast("double").alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    basic = wide.select(_rows([F.col(f"s{i}") for i in range(len(columns))])).select("r.*")
    cuts = quantiles(clean, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")
    )
    return basic.join(cuts, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def value_counts(df: DataFrame, columns: Sequence[str], rows: str | None = None) -> DataFrame:
    """(column, value, n) over several columns, values as text, missing dropped; `rows` says how many rows each stands for."""
    n = quoted(rows) if rows else F.lit(1)
    clean = nan_to_null(df.select(*[quoted(c) for c in columns], n.cast("long").alias("_n")))
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        clean.select(_rows(cells), "_n")
        .where(F.col("r.value").isNotNull())
        .groupBy(F.col("r.column").alias("column"), F.col("r.value").alias("value"))
        .agg(F.sum("_n").alias("n"))
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, unique, top, freq); the smallest value wins a tie for top."""
    columns = list(categorical_columns(df) if columns is None else columns)
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.sum("n").alias("count"),
            F.count("*").alias("unique"),
            F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"),
        )
        .select(
            "column",
            "count",
            "unique",
            F.col("best.value").alias("top"),
            (-F.col("best.col1")).alias("freq"),
        )
    )


def describe_temporal(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, first, last) of dates and timestamps, the ends as text."""
    columns = list(temporal_columns(df) if columns is None else columns)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(quoted(c)).alias("count"),
                F.min(quoted(c)).cast("string").alias("first"),
                F.max(quoted(c)).cast("string").alias("last"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(_rows([F.col(f"s{i}") for i in range(len(columns))])).select("r.*")


def describe(df: DataFrame) -> DataFrame:
    """All kinds in one table: numbers, then text and booleans, then dates; cells
    that do not apply are NULL.  Nested columns are left out."""
    named = [*categorical_columns(df), *boolean_columns(df)]
    parts = [describe_numeric(df)] if numeric_columns(df) else []
    parts += [describe_categorical(df, named)] if named else []
    parts += [describe_temporal(df)] if temporal_columns(df) else []
    if not parts:
        raise ValueError("no column to describe")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share), most frequent first; missing values are dropped."""
    counts = (
        nan_to_null(df.select(quoted(column).alias("value")))
        .where("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("count"))
    )
    n = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.round(F.col("count") / n, 4)).orderBy(
        F.col("count").desc(), "value"
    )


def detect_task_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_values, task): text or at most 20 values is classification.

    The cardinality sketch only rules columns out: 20 distinct values touch at
    most 20 registers, which estimates well under 64.  Columns under that are
    counted exactly.  Over 20 values the count is reported as NULL.
    """
    columns = list(df.columns if columns is None else columns)
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    sketch = clean.agg(
        *[F.approx_count_distinct(quoted(c)).alias(f"a{i}") for i, c in enumerate(columns)]
    ).first()
    few = [c for i, c in enumerate(columns) if sketch[f"a{i}"] <= 64]
    kinds = {f.name: type_class(f.dataType) for f in df.schema}
    names = df.sparkSession.createDataFrame(
        [(c, kinds[c]) for c in columns], "column string, type_class string"
    )
    if few:
        exact = value_counts(clean, few).groupBy("column").agg(
            F.count("*").alias("distinct_values")
        )
    else:
        exact = df.sparkSession.createDataFrame([], "column string, distinct_values long")
    counted = F.col("column").isin(few) if few else F.lit(False)
    exactly = F.when(counted, F.coalesce(F.col("distinct_values"), F.lit(0)))
    values = F.when(exactly <= CLASSIFICATION_MAX_VALUES, exactly)
    return names.join(exact, "column", "left").select(
        "column",
        values.alias("distinct_values"),
        F.when(
            (F.col("type_class") == "categorical")
            | values.isNotNull(),
            "classification",
        ).otherwise("regression").alias("task"),
    )


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every pair, as (col_i, col_j, r) with both halves and the
    diagonal.  Pairs use the rows where both are present; a column that is constant
    in these rows gives NULL.

    Two scans: means, then the products of all columns, of their squares and of
    their presence, as matrices that tasks add up.  Beyond CORRELATION_COLUMNS the
    pairs of blocks of columns take a scan each.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    clean = nan_to_null(df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    means = clean.agg(*[F.avg(c).alias(c) for c in clean.columns]).first()
    centred = clean.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in clean.columns])
    starts = range(0, len(columns), CORRELATION_COLUMNS)
    found = [
        part
        for i in starts
        for j in starts
        if i <= j
        for part in _block_correlation(centred, columns, range(i, min(i + CORRELATION_COLUMNS, len(columns))), range(j, min(j + CORRELATION_COLUMNS, len(columns))))
    ]
    return df.sparkSession.createDataFrame(pd.concat(found), "col_i string, col_j string, r double")


def _block_correlation(centred: DataFrame, columns: list[str], left: range, right: range) -> list[pd.DataFrame]:
    """r of the columns of two blocks, in both directions."""

    def products(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        side = lambda block: np.column_stack([values[names.index(f"c{i}")] for i in block]).astype(np.float64)
        x, y = side(left), side(right)
        p, q = (~np.isnan(x)).astype(np.float64), (~np.isnan(y)).astype(np.float64)
        x, y = np.nan_to_num(x, nan=0.0), np.nan_to_num(y, nan=0.0)
        return dict(enumerate((x.T @ y, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), p.T @ q)))

    names = [f"c{i}" for i in dict.fromkeys([*left, *right])]
    sums = summed_matrices(centred.select(*names), products)
    if not sums:
        r = np.full((len(left), len(right)), np.nan)
    else:
        xy, sx, sy, xx, yy, n = (sums[k] for k in range(6))
        with np.errstate(divide="ignore", invalid="ignore"):
            own, other = xx - sx * sx / n, yy - sy * sy / n
            # equal values leave rounding only
            varies = (own > 1e-12 * xx) & (other > 1e-12 * yy)
            r = np.where(varies, np.clip((xy - sx * sy / n) / np.sqrt(own * other), -1.0, 1.0), np.nan)
    cell = lambda one, two, values: pd.DataFrame({
        "col_i": np.repeat([columns[i] for i in one], len(two)), "col_j": np.tile([columns[j] for j in two], len(one)),
        "r": pd.Series(values.ravel(), dtype=object).where(~np.isnan(values.ravel()), None)})
    return [cell(left, right, r)] if left == right else [cell(left, right, r), cell(right, left, r.T)]


def profile(df: DataFrame) -> DataFrame:
    """Long table (column, metric, value): size, duplicates, missing values and
    the numeric summary; table-wide facts carry the column name ``*``."""
    def fact(column: str, metric: str, value: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"))

    cells = [fact("*", "row_count", F.col("n")), fact("*", "features", F.lit(len(df.columns)))]
    for i, c in enumerate(df.columns):
        cells += [fact(c, "missing", F.col(f"m{i}")), fact(c, "missing_percent", _missing_percent(i))]
    facts = _missing_counts(df).select(_rows(cells)).select("r.*")
    duplicates = duplicate_rows(df).select(
        F.lit("*").alias("column"),
        F.lit("duplicate_rows").alias("metric"),
        F.col("duplicate_rows").cast("double").alias("value"),
    )
    out = facts.unionByName(duplicates)
    if numeric_columns(df):
        numbers = numeric_summary(df).select(
            "column",
            F.expr(
                "stack(5, 'mean', mean, 'std', std, 'min', min, 'max', max, 'median', median)"
            ).alias("metric", "value"),
        )
        out = out.unionByName(numbers)
    return out
