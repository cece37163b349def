"""Write tables for BI tools and keep a list of what was written."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.columns import nested_columns, quoted


class Exporter:
    """Writes below one folder; every table becomes a folder of part files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.written: list[tuple[str, str, str]] = []

    def _path(self, name: str, kind: str) -> str:
        return f"{self.folder}/{name}.{kind}"

    def _done(self, name: str, kind: str) -> str:
        """Lists an output, once it has been written."""
        self.written.append((name, kind, self._path(name, kind)))
        return self._path(name, kind)

    def to_csv(self, df: DataFrame, name: str, one_file: bool = False) -> str:
        """Header, overwrite; nested columns as JSON.  ``one_file`` is for tables
        known to be small: a single task writes them."""
        nested = set(nested_columns(df))
        flat = df.select(*[F.to_json(quoted(c)).alias(c) if c in nested else quoted(c) for c in df.columns])
        (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option(
            "header", True
        ).option("escape", '"').csv(self._path(name, "csv"))
        return self._done(name, "csv")

    def to_parquet(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").parquet(self._path(name, "parquet"))
        return self._done(name, "parquet")

    def to_json(self, df: DataFrame, name: str) -> str:
        """One record per line."""
        df.write.mode("overwrite").json(self._path(name, "json"))
        return self._done(name, "json")

    def export_all(self, tables: dict[str, DataFrame], include_parquet: bool = True) -> list[str]:
        """CSV and parquet of each table; the CSV is made from the written parquet, so
        that a table is computed once."""
        paths = []
        for name, df in tables.items():
            if include_parquet:
                df.write.mode("overwrite").parquet(self._path(name, "parquet"))
                df = self.spark.read.schema(df.schema).parquet(self._path(name, "parquet"))
            paths.append(self.to_csv(df, name))
            if include_parquet:
                paths.append(self._done(name, "parquet"))
        return paths

    def exported(self) -> DataFrame:
        """(position, name, format, path) in writing order."""
        rows = [(i + 1, *w) for i, w in enumerate(self.written)]
        return self.spark.createDataFrame(
            rows, "position int, name string, format string, path string"
        )

    def predictions(self, scored: DataFrame, name: str = "predictions") -> str:
        """A scored table (original columns, prediction, prob_class_i) as CSV."""
        if "prediction" not in scored.columns:
            raise ValueError("the table has no column prediction")
        return self.to_csv(scored, name)

    def data_model(
        self, tables: dict[str, DataFrame], relationships: Sequence[dict[str, str]] = ()
    ) -> DataFrame:
        """Write the manifest as JSON and return its columns."""
        columns = model_columns(tables)
        self.to_json(columns, "data_model_columns")
        if relationships:
            self.to_json(model_relationships(self.spark, relationships), "data_model_relationships")
        return columns


def model_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, type, row_count, is_primary_key,
    created_at); the first column counts as the key, unchecked."""
    spark = next(iter(tables.values())).sparkSession
    schema = [
        (t, i + 1, f.name, f.dataType.simpleString(), i == 0)
        for t, df in tables.items()
        for i, f in enumerate(df.schema)
    ]
    columns = spark.createDataFrame(
        schema,
        "table_name string, ordinal int, column_name string, type string, is_primary_key boolean",
    )
    counts = None
    for t, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(t))
        counts = part if counts is None else counts.unionByName(part)
    return columns.join(counts, "table_name").select(
        "table_name", "ordinal", "column_name", "type", "row_count", "is_primary_key",
        F.current_timestamp().alias("created_at"),
    )


def model_relationships(spark: SparkSession, relationships: Sequence[dict[str, str]]) -> DataFrame:
    """One row per relationship, keys as columns."""
    keys = list(dict.fromkeys(k for r in relationships for k in r))
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in relationships], schema)


def analysis_results(
    spark: SparkSession, ml: dict[str, object] | None = None, dl: dict[str, object] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Three long metric rows: model score (accuracy, else mse, else 0), device, row
    count.  ``metric_value`` is text, ``metric_value_num`` the number if it is one."""
    ml, dl = ml or {}, dl or {}
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    name = "accuracy" if "accuracy" in ml else "mse"
    rows = [
        ("Machine Learning", name, str(ml.get("accuracy", ml.get("mse", 0))), now),
        ("Deep Learning", "device", str(dl.get("device", "unknown")), now),
    ]
    out = spark.createDataFrame(
        rows,
        "metric_category string, metric_name string, metric_value string, timestamp timestamp_ntz",
    )
    if summary is None:
        count = spark.createDataFrame([(0,)], "row_count long")
    else:
        count = summary.select("row_count")
    out = out.unionByName(
        count.select(
            F.lit("Data Summary").alias("metric_category"), F.lit("row_count").alias("metric_name"),
            F.col("row_count").cast("string").alias("metric_value"),
            F.lit(now).cast("timestamp_ntz").alias("timestamp"),
        )
    )
    return out.withColumn("metric_value_num", F.col("metric_value").try_cast("double"))


def dashboard_tables(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Up to three tables: feature_importance, predictions, metrics_summary (the
    metrics that are numbers)."""
    out = {k: results[k] for k in ("feature_importance", "predictions") if k in results}
    if "metrics" in results:
        out["metrics_summary"] = results["metrics"].where("value is not null").select("metric", "value")
    return out
