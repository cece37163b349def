"""Evaluation of predictions as aggregates over label and prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.columns import quoted
from gridlens.operators.ranking import bucket_of, distinct_points, split_points


def _counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(
        quoted(label).cast("string").alias("actual"),
        quoted(prediction).cast("string").alias("predicted"),
    ).agg(F.count("*").alias("count"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """(actual, predicted, count, share) of the cells that occur; share is the
    count over its row's total.  With `labels` the matrix of exactly these, in
    their order, zero cells included."""
    counts = _counts(df, label, prediction)
    if labels is not None:
        given = F.array(*[F.lit(str(x)) for x in labels]) if labels else F.array().cast("array<string>")
        one = df.sparkSession.range(1)
        cells = one.select(F.explode(given).alias("actual"), given.alias("l"))
        cells = cells.select("actual", F.explode("l").alias("predicted"))
        counts = F.broadcast(cells).join(counts, ["actual", "predicted"], "left").select(
            "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count")
        ).orderBy(F.array_position(given, F.col("actual")), F.array_position(given, F.col("predicted")))
    totals = counts.groupBy(F.col("actual").alias("_a")).agg(F.sum("count").alias("_n"))
    joined = counts.join(totals, F.col("actual").eqNullSafe(F.col("_a")))
    return joined.select("actual", "predicted", "count", (F.col("count") / (F.col("_n") + F.lit(1e-9))).alias("share"))


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where undefined."""
    counts = _counts(df, label, prediction)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), hit.alias("tp"),
                         F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                         F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted")),
            )
        ).alias("r")
    ).select("r.*")
    sums = sides.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )
    zero = F.lit(0.0)
    return sums.select(
        "label",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero).alias("recall"),
        F.coalesce(
            F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero
        ).alias("f1"),
        "support",
        "tp",
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg, to 4 digits."""
    classes = per_class(df, label, prediction)
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), n)

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), n.alias("support"))

    none = F.max(F.lit(None).cast("double"))
    accuracy = F.try_divide(F.sum("tp"), n)
    summary = classes.agg(
        F.array(
            row("accuracy", none, none, accuracy),
            row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return classes.drop("tp").unionByName(summary).select(
        "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def accuracy_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted F1, to 4 digits."""
    return per_class(df, label, prediction).agg(
        F.round(F.try_divide(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 4)
        .alias("f1_score"),
    )


def roc_auc(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """One row (roc_auc): the share of positive-negative pairs in the right order,
    ties counting half; NULL unless both classes occur.

    Rows collapse to one per distinct score; running counts are taken per
    score bucket and shifted by the bucket totals, so no task sees all scores.
    """
    cuts = distinct_points(split_points(df.select(quoted(score).cast("double").alias("s")), "s"))
    by_score = (
        df.where(quoted(label).isNotNull() & quoted(score).isNotNull())
        .groupBy(quoted(score).cast("double").alias("s"))
        .agg(
            F.count_if(quoted(label) == F.lit(positive)).alias("pos"),
            F.count_if(quoted(label) != F.lit(positive)).alias("neg"),
        )
        .withColumn("b", bucket_of(F.col("s"), cuts))
    )
    before = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    buckets = (
        by_score.withColumn("below", below)
        .groupBy("b")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("pairs"),
        )
    )
    earlier = Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    shifted = buckets.withColumn("lower", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    return shifted.agg(
        F.try_divide(
            F.sum(F.col("pairs") + F.col("pos") * F.col("lower").cast("double")),
            F.sum("pos").cast("double") * F.sum("neg").cast("double"),
        ).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mse, rmse, mae, r2_score, unrounded; r2 is NULL for a constant label."""
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    return df.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2_score"),
    )


def fold_scores(df: DataFrame, task: str, label: str, prediction: str, fold: str = "fold") -> DataFrame:
    """(fold, score): accuracy or R2 of out-of-fold predictions."""
    if task == "classification":
        score = F.avg((quoted(label) == quoted(prediction)).cast("double"))
    else:
        y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
        score = 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))
    return df.groupBy(quoted(fold).alias("fold")).agg(score.alias("score"))


def weighted_fold_sums(df: DataFrame, task: str, label: str, prediction: str, rows: str, fold: str = "fold") -> DataFrame:
    """(fold, mean): the share of hits or the mean squared error, where a row stands for `rows` of them."""
    if task == "classification":
        one = (quoted(label) == quoted(prediction)).cast("double")
    else:
        one = (quoted(label).cast("double") - quoted(prediction).cast("double")) ** 2
    n = quoted(rows).cast("double")
    return df.groupBy(quoted(fold).alias("fold")).agg(
        F.try_divide(F.sum(one * n), F.sum(F.when(one.isNotNull(), n))).alias("mean"))


def weighted_spreads(df: DataFrame, label: str, rows: str, fold: str = "fold") -> DataFrame:
    """(fold, spread): the variance of a number, where a row stands for `rows` of them; exactly 0 for equal numbers."""
    y = quoted(label).cast("double")
    known = df.select(quoted(fold).alias("fold"), y.alias("y"), F.when(y.isNotNull(), quoted(rows)).cast("double").alias("n"))
    low = F.min("y")
    centres = known.groupBy("fold").agg(
        F.when(low == F.max("y"), low).otherwise(F.try_divide(F.sum(F.col("y") * F.col("n")), F.sum("n"))).alias("centre"))
    off = F.col("y") - F.col("centre")
    return known.join(centres, "fold").groupBy("fold").agg(F.try_divide(F.sum(off * off * F.col("n")), F.sum("n")).alias("spread"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """One row (cv_mean, cv_std): population deviation over the folds."""
    return scores.agg(
        F.round(F.avg("score"), 4).alias("cv_mean"), F.round(F.stddev_pop("score"), 4).alias("cv_std")
    )
