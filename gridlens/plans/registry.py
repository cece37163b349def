"""Registry of the named queries and the derived tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def texts(self) -> DataFrame:
        """Documents on all cores: their work per row is large."""
        return spread(self.documents)

    @property
    def events_missing(self) -> DataFrame:
        """Events where errors carry no value and large values no type."""
        e = self.events
        return e.select(
            "event_id", "ts", "user_id",
            F.when(F.col("value") <= 100, F.col("event_type")).alias("event_type"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        )

    @property
    def rated(self) -> DataFrame:
        """All documents with their labels, which most of them lack."""
        return self.documents.select("doc_id", "lang", "source", "n_chars").join(
            self.labels, "doc_id", "left"
        )

    @property
    def class_predictions(self) -> DataFrame:
        """Labelled documents; long ones are predicted to be of quality."""
        return self.labels.join(self.documents.select("doc_id", "n_chars", "lang"), "doc_id").withColumn(
            "pred", F.when(F.col("n_chars") > 2000, 1).otherwise(0)
        )

    @property
    def price_predictions(self) -> DataFrame:
        """Orders predicted by a linear rule on their key."""
        return self.orders.select(
            "o_orderkey", "o_orderpriority", "o_totalprice",
            (F.col("o_custkey") * 10.0 + 200000.0).alias("predicted"),
        )


EVENTS_MISSING = """(SELECT event_id, ts, user_id,
  CASE WHEN value <= 100 THEN event_type END AS event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""
RATED = """(SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CLASS_PREDICTIONS = """(SELECT l.doc_id, quality, toxic, n_chars, lang,
  CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
PRICE_PREDICTIONS = """(SELECT o_orderkey, o_orderpriority, o_totalprice,
  CAST(o_custkey AS DOUBLE) * 10 + 200000 AS predicted FROM orders)"""


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """Round the fractional columns, so that summation order does not show."""
    types = dict(df.dtypes)
    return df.select(
        *[
            F.round(F.col(c), other.get(c, digits)).alias(c) if types[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )
