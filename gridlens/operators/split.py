"""Deterministic splits: rows are ordered by the md5 of their id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.columns import quoted
from gridlens.operators.ranking import bucketed_row_number, lookup_join
from gridlens.session import materialise

HASH_BUCKET_DIGITS = 3


def row_hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(quoted(id_column).cast("string"), F.lit(f"|{seed}")))


def hash_positions(df: DataFrame, id_column: str, label: str | None, seed: int) -> DataFrame:
    """Append ``_pos``, the row number in hash order (per class if stratified).

    The leading hash digits cut every class into 4096 even buckets, so a class
    that holds a third of the table is not sorted in one task.
    """
    hashed = df.withColumn("_hash", row_hash(id_column, seed))
    return bucketed_row_number(
        hashed,
        [label] if label else [],
        F.substring("_hash", 1, HASH_BUCKET_DIGITS),
        [F.col("_hash"), quoted(id_column)],
        "_pos",
    ).drop("_hash")


def can_stratify(df: DataFrame, label: str, min_classes: int = 2) -> bool:
    """Every class has two rows or more, and there are enough classes."""
    row = (
        df.groupBy(quoted(label)).agg(F.count("*").alias("n"))
        .agg(F.min("n").alias("least"), F.count("*").alias("classes")).first()
    )
    return (row["least"] or 0) >= 2 and row["classes"] >= min_classes


def train_test_split(
    df: DataFrame, id_column: str, label: str | None = None, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Append ``is_test``; stratified by label where every class has two rows."""
    if label is not None and not can_stratify(df, label):
        label = None
    placed = hash_positions(df, id_column, label, seed)
    return _mark_test(df, placed, label, test_size).select(*df.columns, "is_test")


def kfold(
    df: DataFrame, id_column: str, label: str | None = None, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Append ``fold`` (0 .. folds-1), dealt out in hash order, per class if given."""
    placed = hash_positions(df, id_column, label, seed)
    return placed.withColumn("fold", _fold(folds)).select(*df.columns, "fold")


def split_and_folds(
    df: DataFrame, id_column: str, label: str | None, test_size: float, folds: int, seed: int = 42
) -> DataFrame:
    """Append ``is_test`` and ``fold`` with one ordering pass.

    Rows are written with their number within (hash bucket, class), for which they are
    dealt and hashed once; the rows of earlier buckets are counted in the written table
    and added when it is read.  No bucket after the last one of the held-out rows is read
    for these: a file is in the order of its buckets.
    """
    _check_share(test_size)
    if label is not None and not can_stratify(df, label):
        label = None
    keys = ["_bucket", *([label] if label else [])]
    hashed = df.withColumn("_hash", row_hash(id_column, seed))
    tagged = hashed.withColumn("_bucket", F.substring("_hash", 1, HASH_BUCKET_DIGITS)).withColumn("_hash", F.unhex("_hash"))
    # the bucket comes first, so that most comparisons end there
    within = Window.partitionBy(*[quoted(k) for k in keys]).orderBy("_hash", quoted(id_column))
    numbered = tagged.withColumn("_rn", F.row_number().over(within)).drop("_hash")
    stored = materialise(numbered, "split")
    by = Window.partitionBy(*[quoted(k) for k in keys[1:]])
    earlier = by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialise(stored.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("_n")).select(
        *[quoted(k) for k in keys], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        _test_rows(F.sum("_n").over(by), test_size).alias("_n_test")), "buckets")
    last = buckets.where("_before < _n_test").agg(F.max("_bucket")).first()[0]
    near = F.col("_bucket").isNull() | (F.col("_bucket") <= F.lit(last or ""))
    placed = lookup_join(stored, buckets, keys).withColumn("_pos", F.col("_rn") + F.col("_before"))
    return placed.select(*[quoted(c) for c in df.columns], (near & (F.col("_pos") <= F.col("_n_test"))).alias("is_test"), _fold(folds).alias("fold"))


def _check_share(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size lies between 0 and 1")


def _test_rows(n: Column, test_size: float) -> Column:
    return F.greatest(F.lit(1), F.round(n * F.lit(test_size)).cast("long"))


def _mark_test(df: DataFrame, placed: DataFrame, label: str | None, test_size: float) -> DataFrame:
    _check_share(test_size)
    by = [label] if label else []
    sizes = df.groupBy(*by).agg(
        _test_rows(F.count("*"), test_size).alias("_n_test")
    )
    if by:
        sized = lookup_join(placed, sizes, by)
    else:
        sized = placed.withColumn("_n_test", sizes.scalar())
    return sized.withColumn("is_test", F.col("_pos") <= F.col("_n_test"))


def _fold(folds: int) -> Column:
    if folds < 2:
        raise ValueError("at least two folds")
    return ((F.col("_pos") - 1) % folds).cast("int")
