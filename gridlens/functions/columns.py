"""Type classes of columns and the one meaning of "missing"."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans do not count as numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, STRING_TYPES)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NESTED_TYPES)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, STRING_TYPES):
        return "categorical"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, NESTED_TYPES):
        return "nested"
    return "other"


def quoted(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """Hash over all columns; maps, which have no order, are left out."""
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[quoted(c) for c in plain]) if plain else F.lit(0).cast("long")


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN in fractional columns."""
    c = quoted(name)
    if name in fractional_columns(df):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL so that aggregates skip it."""
    fractional = set(fractional_columns(df))
    if not fractional:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in fractional else quoted(c)
            for c in df.columns
        ]
    )


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}; table has {df.columns}")
