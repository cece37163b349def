"""Findings about a table as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.columns import nan_to_null, numeric_columns, quoted
from gridlens.operators import profile as prof
from gridlens.operators.chartdata import tukey_fences
from gridlens.operators.ranking import lookup_join, with_ordinal

MISSING_LIMIT, CORRELATION_LIMIT, CLASS_SHARE_LIMIT, Z_LIMIT = 5.0, 0.9, 0.10, 3.0


def general_insights(df: DataFrame) -> DataFrame:
    """(fact, subject, value): size, missing share, duplicates, strongest correlation."""
    spark = df.sparkSession
    missing = prof.missing_values(df)
    size = prof.table_size(df)
    facts = size.select(
        F.expr(
            "stack(2, 'row_count', '*', cast(row_count as double), 'features', '*', cast(features as double))"
        ).alias("fact", "subject", "value")
    )
    cells = F.col("row_count") * F.col("features")
    share = missing.agg(F.sum("missing").alias("m"))
    total_cells = size.select(cells).scalar()
    facts = facts.unionByName(
        share.select(
            F.lit("missing_percent").alias("fact"), F.lit("*").alias("subject"),
            F.round(F.try_divide(F.col("m") * 100.0, total_cells), 2).alias("value"),
        )
    ).unionByName(
        prof.duplicate_rows(df).select(
            F.lit("duplicate_rows").alias("fact"), F.lit("*").alias("subject"),
            F.col("duplicate_rows").cast("double").alias("value"),
        )
    )
    if len(numeric_columns(df)) < 2:
        return facts
    pairs = prof.correlation(df).where("col_i < col_j and r is not null")
    strongest = pairs.orderBy(F.round(F.abs("r"), 9).desc(), "col_i", "col_j").limit(1)
    return facts.unionByName(
        strongest.select(
            F.lit("strongest_correlation").alias("fact"),
            F.concat_ws(" / ", "col_i", "col_j").alias("subject"),
            F.round("r", 4).alias("value"),
        )
    )


def trends(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """(period, n, total, mean, change, slope): change of the total against the
    period before; slope of the totals over the period number (from 0).

    Periods are numbered by ranges, each meets the one before by its number, and the
    slope comes from sums, so a fine grain over many years needs no single task.
    """
    clean = nan_to_null(df.select(quoted(date).alias("d"), quoted(value).cast("double").alias("v")))
    periods = (
        clean.where("d is not null")
        .groupBy(F.date_trunc(grain, "d").alias("period"))
        .agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))
    )
    numbered = with_ordinal(periods, "period", ["n"], "i")
    known = numbered.where("total is not null")
    middle = known.agg(F.avg("i").alias("i"), F.avg("total").alias("total")).first()
    slope = None
    if middle["i"] is not None:
        x, y = F.col("i") - F.lit(middle["i"]), F.col("total") - F.lit(middle["total"])
        slope = known.agg(F.try_divide(F.sum(x * y), F.sum(x * x)).alias("slope")).first()["slope"]
    before = numbered.select((F.col("i") + 1).alias("i"), F.col("total").alias("_before"))
    return numbered.join(before, "i", "left").select(
        "period", "n", "total", "mean",
        (F.col("total") - F.col("_before")).alias("change"),
        F.lit(slope).cast("double").alias("slope"),
    )


def anomalies(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows outside the Tukey fences of their group or more than three deviations
    from its mean, with z, outside_fences and extreme_z appended."""
    by = list(by)
    clean = nan_to_null(df).where(quoted(value).isNotNull())
    fences = tukey_fences(clean, value, by).select(*by, "lower_fence", "upper_fence")
    spread_ = clean.groupBy(*by).agg(F.avg(quoted(value)).alias("_mean"),
                                     F.stddev_samp(quoted(value)).alias("_std"))
    if by:
        measured = lookup_join(clean, lookup_join(fences, spread_, by), by)
    else:
        f, s = fences.first(), spread_.first()
        measured = clean.select(
            "*", F.lit(f["lower_fence"]).alias("lower_fence"),
            F.lit(f["upper_fence"]).alias("upper_fence"),
            F.lit(s["_mean"]).alias("_mean"), F.lit(s["_std"]).alias("_std"),
        )
    z = F.try_divide(quoted(value) - F.col("_mean"), F.col("_std"))
    return (
        measured.withColumn("z", z)
        .withColumn("outside_fences", ~quoted(value).between(F.col("lower_fence"), F.col("upper_fence")))
        .withColumn("extreme_z", F.coalesce(F.abs("z") > Z_LIMIT, F.lit(False)))
        .where("outside_fences or extreme_z")
        .select(*df.columns, "z", "outside_fences", "extreme_z")
    )


def recommendations(df: DataFrame, class_columns: Sequence[str] = ()) -> DataFrame:
    """(rule, subject, value): what to look at before modelling.

    Missing share over 5 %, any duplicates, constant columns, |r| over 0.9,
    classes with a share under 10 %.
    """
    out = prof.missing_values(df).where(F.col("missing_percent") > MISSING_LIMIT).select(
        F.lit("missing_values").alias("rule"), F.col("column").alias("subject"),
        F.col("missing_percent").alias("value"),
    )
    out = out.unionByName(
        prof.duplicate_rows(df).where("duplicate_rows > 0").select(
            F.lit("duplicate_rows").alias("rule"), F.lit("*").alias("subject"),
            F.col("duplicate_rows").cast("double").alias("value"),
        )
    )
    clean = nan_to_null(df)
    simple = [f.name for f in df.schema if prof.type_class(f.dataType) != "nested"]
    constant = clean.agg(
        *[
            F.struct(
                F.lit(c).alias("subject"),
                (F.min(quoted(c)) == F.max(quoted(c))).alias("same"),
            ).alias(f"s{i}")
            for i, c in enumerate(simple)
        ]
    ).select(F.explode(F.array(*[f"s{i}" for i in range(len(simple))])).alias("r"))
    out = out.unionByName(
        constant.where("r.same").select(
            F.lit("constant_column").alias("rule"), F.col("r.subject").alias("subject"),
            F.lit(1.0).alias("value"),
        )
    )
    if len(numeric_columns(df)) >= 2:
        out = out.unionByName(
            prof.correlation(df)
            .where((F.col("col_i") < F.col("col_j")) & (F.abs("r") > CORRELATION_LIMIT))
            .select(
                F.lit("high_correlation").alias("rule"),
                F.concat_ws(" / ", "col_i", "col_j").alias("subject"),
                F.round("r", 4).alias("value"),
            )
        )
    if class_columns:
        counts = prof.value_counts(df, class_columns)
        totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
        share = F.col("n") / F.col("total")
        out = out.unionByName(
            lookup_join(counts, totals, ["column"]).withColumn("share", share).where(F.col("share") < CLASS_SHARE_LIMIT).select(
                F.lit("rare_class").alias("rule"),
                F.concat_ws(" = ", "column", "value").alias("subject"),
                F.round("share", 4).alias("value"),
            )
        )
    return out


def analysis_report(
    profile: DataFrame | None = None, metrics: DataFrame | None = None,
    model: dict[str, str] | None = None,
) -> DataFrame:
    """Long (section, key, value): model facts, metrics, profile."""
    parts = []
    if profile is not None:
        parts.append(
            profile.select(
                F.lit("profile").alias("section"),
                F.concat_ws(".", "column", "metric").alias("key"),
                F.col("value").cast("string").alias("value"),
            )
        )
    if metrics is not None:
        parts.append(
            metrics.select(F.lit("metrics").alias("section"), F.col("metric").alias("key"),
                           F.col("value").cast("string").alias("value"))
        )
    if not parts:
        raise ValueError("nothing to report")
    if model:
        parts.append(
            parts[0].sparkSession.createDataFrame(
                [("model", k, str(v)) for k, v in model.items()],
                "section string, key string, value string",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
