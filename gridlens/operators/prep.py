"""Cleaning and feature preparation as expressions over fitted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.columns import (
    NESTED_TYPES,
    boolean_columns,
    categorical_columns,
    is_missing,
    nan_to_null,
    nested_columns,
    numeric_columns,
    quoted,
    require_columns,
)
from gridlens.operators.profile import columns_with_missing, value_counts
from gridlens.operators.ranking import lookup_join, quantiles, with_ordinal

# Fixed value: text that counts as a number (blanks around it are allowed).
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
MAX_ONE_HOT_COLUMNS = 1000


def select_type(df: DataFrame, kind: str) -> DataFrame:
    """Columns of one type class: numeric, categorical or boolean."""
    pick = {
        "numeric": numeric_columns, "categorical": categorical_columns, "boolean": boolean_columns,
    }[kind]
    return df.select(*[quoted(c) for c in pick(df)])


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [target])
    return df.drop(target), df.select(quoted(target))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Remove columns that hold no value at all."""
    row = df.agg(
        *[F.bool_or(~is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if row[f"c{i}"]])


def text_as_number(value: Column) -> Column:
    """Number written in a text, NULL if the text is no number."""
    trimmed = F.trim(value)
    return F.when(F.lower(value).rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def numeric_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, values, unparsable, is_numeric) for text columns; '' is missing."""
    columns = list(categorical_columns(df) if columns is None else columns)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.nullif(quoted(c), F.lit(""))).alias("values"),
                F.count_if(
                    F.nullif(quoted(c), F.lit("")).isNotNull() & text_as_number(quoted(c)).isNull()
                ).alias("unparsable"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return (
        wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("r"))
        .select("r.*")
        .withColumn("is_numeric", F.col("unparsable") == 0)
    )


def coerce_numeric(df: DataFrame, otherwise: str = "drop") -> DataFrame:
    """Turn text columns into numbers where every value parses.

    Other text columns are dropped, one-hot encoded or kept, by ``otherwise``
    (drop, one_hot, keep).
    """
    text = categorical_columns(df)
    if not text:
        return df
    verdict = {r["column"]: r["is_numeric"] for r in numeric_text_columns(df, text).collect()}
    out = []
    for c in df.columns:
        if c not in verdict or (not verdict[c] and otherwise != "drop"):
            out.append(quoted(c))
        elif verdict[c]:
            out.append(text_as_number(quoted(c)).alias(c))
    parsed = df.select(*out)
    if otherwise != "one_hot":
        return parsed
    return one_hot(parsed, [c for c in text if not verdict[c]])


def categories(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """Sorted categories per column; an error if there are more than ``limit``."""
    rows = value_counts(df, columns).limit(limit + 1).collect() if columns else []
    if len(rows) > limit:
        raise ValueError(
            f"over {limit} categories in {list(columns)}, one column each: give a higher limit, or "
            "use label_encode or the sparse encoding of features.fit_features"
        )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def one_hot(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_ONE_HOT_COLUMNS
) -> DataFrame:
    """One 0/1 column ``col_value`` per category but the first in sort order.

    Missing values become all zeros, a column with one category vanishes, and
    the new columns come after the untouched ones.
    """
    columns = list(categorical_columns(df) if columns is None else columns)
    found = categories(df, columns, limit)
    kept = [quoted(c) for c in df.columns if c not in columns]
    flags = [
        F.coalesce((quoted(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in found[c][1:]
    ]
    return df.select(*kept, *flags)


def booleans_to_int(df: DataFrame) -> DataFrame:
    flags = set(boolean_columns(df))
    return df.select(*[quoted(c).cast("int").alias(c) if c in flags else quoted(c) for c in df.columns])


def fill_values(df: DataFrame, strategy: str = "median") -> DataFrame:
    """(column, kind, number, text): the value that would replace missing cells.

    Numbers take the median, the mean or 0; booleans false; other columns
    their most frequent value (the smallest of equals), or "unknown"; nested
    ones are compared and given as JSON.
    """
    if strategy not in ("median", "mean", "zero"):
        raise ValueError("strategy is median, mean or zero")
    clean = nan_to_null(df)
    spark = df.sparkSession
    numbers, flags = numeric_columns(df), boolean_columns(df)
    others = [c for c in df.columns if c not in numbers and c not in flags]
    parts = []
    if numbers:
        if strategy == "median":
            part = quantiles(clean, numbers, [0.5]).select("column", F.col("q0").alias("number"))
        elif strategy == "mean":
            part = (
                clean.agg(*[F.avg(quoted(c)).alias(f"a{i}") for i, c in enumerate(numbers)])
                .select(F.explode(F.array(*[
                    F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("number"))
                    for i, c in enumerate(numbers)])).alias("r"))
                .select("r.*")
            )
        else:
            part = spark.createDataFrame([(c, 0.0) for c in numbers], "column string, number double")
        parts.append(part.select("column", F.lit("numeric").alias("kind"), "number",
                                 F.lit(None).cast("string").alias("text")))
    if flags:
        parts.append(spark.createDataFrame([(c, "boolean", 0.0, "false") for c in flags],
                                           "column string, kind string, number double, text string"))
    if others:
        nested = set(nested_columns(df))
        plain = clean.select(*[F.to_json(quoted(c)).alias(c) if c in nested else quoted(c) for c in others])
        modes = value_counts(plain, others).groupBy("column").agg(
            F.min(F.struct(-F.col("n"), F.col("value"))).alias("best")
        )
        names = spark.createDataFrame([(c,) for c in others], "column string")
        parts.append(
            names.join(modes, "column", "left").select(
                "column", F.lit("other").alias("kind"), F.lit(None).cast("double").alias("number"),
                F.coalesce(F.col("best.value"), F.lit("unknown")).alias("text"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_missing(df: DataFrame, strategy: str = "median") -> DataFrame:
    """Replace missing cells by :func:`fill_values` in the columns that have any;
    one row per such column is fetched."""
    affected = [r["column"] for r in columns_with_missing(df).collect()]
    if not affected:
        return df
    found = fill_values(df.select(*[quoted(c) for c in affected]), strategy)
    values = {r["column"]: r for r in found.collect()}
    types = {f.name: f.dataType for f in df.schema}
    out = []
    for c in df.columns:
        v = values.get(c)
        number = v is not None and v["kind"] == "numeric"
        fill = None if v is None else (v["number"] if number else v["text"])
        if isinstance(types[c], NESTED_TYPES) and fill is not None:
            # a column without any value stays as it is
            known = F.from_json(F.lit(fill), types[c]) if fill != "unknown" else F.lit(None)
            out.append(F.coalesce(quoted(c), known).alias(c))
            continue
        if fill is None:
            out.append(quoted(c))
            continue
        # a median between two integers is no integer
        whole = isinstance(types[c], T.IntegralType) and number and not float(fill).is_integer()
        target = T.DoubleType() if whole else types[c]
        if not number and not isinstance(types[c], (T.BooleanType, T.StringType)):
            replacement = F.lit(fill).try_cast(target)
        else:
            replacement = F.lit(fill).cast(target)
        value = quoted(c)
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        out.append(F.coalesce(value.cast(target), replacement).alias(c))
    return df.select(*out)


def preprocess(
    df: DataFrame, drop_non_numeric: bool = True, strategy: str = "median"
) -> DataFrame:
    """Drop empty columns, make text numeric (else drop or one-hot it), fill."""
    typed = coerce_numeric(drop_empty_columns(df), "drop" if drop_non_numeric else "one_hot")
    return fill_missing(typed, strategy)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): code is the rank of the value as text; missing is "nan"."""
    values = df.select(
        F.when(is_missing(df, column), F.lit("nan"))
        .otherwise(quoted(column).cast("string")).alias("value")
    ).distinct()
    return with_ordinal(values, "value", name="code").withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Append the code of each row's value."""
    codes = label_codes(df, column).select(F.col("value").alias("_text"), F.col("code").alias(name))
    text = F.when(is_missing(df, column), F.lit("nan")).otherwise(quoted(column).cast("string"))
    return lookup_join(df.withColumn("_text", text), codes, ["_text"]).select(*df.columns, name)


def impute_and_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Median for missing cells, then (x - mean) / population deviation.

    A constant column becomes 0, an empty column is dropped.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    clean = nan_to_null(df)
    medians = {r["column"]: r["q0"] for r in quantiles(clean, columns, [0.5]).collect()}
    kept = [c for c in columns if c in medians]
    filled = {c: F.coalesce(quoted(c).cast("double"), F.lit(medians[c])) for c in kept}
    row = clean.agg(
        *[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"s{i}")
          for i, x in enumerate(filled.values())]
    ).first()
    scaled = {
        c: ((x - F.lit(row[f"s{i}"]["m"])) / F.lit(row[f"s{i}"]["s"] or 1.0)).alias(c)
        for i, (c, x) in enumerate(filled.items())
    }
    return clean.select(
        *[scaled.get(c, quoted(c)) for c in df.columns if c not in columns or c in scaled]
    )


def class_weights(df: DataFrame, label: str, rows: str | None = None) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * n); `rows` says how many rows each stands for."""
    counts = df.where(~is_missing(df, label)).groupBy(quoted(label).alias("label")).agg(
        (F.sum(rows) if rows else F.count("*")).alias("n")
    )
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    share = totals.select(F.col("rows") / F.col("classes")).scalar()
    return counts.withColumn("weight", share / F.col("n"))


def with_class_weights(df: DataFrame, label: str, name: str = "weight", rows: str | None = None) -> DataFrame:
    weights = class_weights(df, label, rows).select(F.col("label").alias(label), F.col("weight").alias(name))
    return lookup_join(df, weights, [label])
