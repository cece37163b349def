"""Profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import profile as prof
from gridlens.operators import ranking
from gridlens.plans.registry import EVENTS_MISSING, RATED, Tables, query, rounded

LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)
RATED_COLUMNS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def _each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS features FROM lineitem")
def profile_size(t: Tables) -> DataFrame:
    return prof.table_size(t.lineitem)


@query(
    _each(LINE_NUMBERS, """SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
      round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
      CAST(max({c}) AS DOUBLE) AS max, round(median(CAST({c} AS DOUBLE)), 4) AS median FROM lineitem""")
)
def profile_numeric(t: Tables) -> DataFrame:
    return rounded(prof.numeric_summary(t.lineitem))


_MISSING = """SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
  round(100.0 * CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), 2) AS missing_percent
  FROM """ + RATED


@query(_each(RATED_COLUMNS, _MISSING))
def profile_missing(t: Tables) -> DataFrame:
    return prof.missing_values(t.rated)


_RATED_TYPES = (
    ("doc_id", "bigint", "numeric"), ("lang", "string", "categorical"), ("source", "string", "categorical"),
    ("n_chars", "bigint", "numeric"), ("quality", "int", "numeric"), ("toxic", "int", "numeric"),
)


@query(
    " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS ordinal, "column", '{kind}' AS type, '{group}' AS type_class,
        missing, missing_percent FROM ({_MISSING.format(c=c)})"""
        for i, (c, kind, group) in enumerate(_RATED_TYPES, start=1)
    )
)
def column_overview(t: Tables) -> DataFrame:
    return prof.column_overview(t.rated)


@query("SELECT * FROM (" + _each(RATED_COLUMNS, _MISSING) + ") WHERE missing > 0")
def missing_columns_only(t: Tables) -> DataFrame:
    return prof.columns_with_missing(t.rated)


@query(
    "SELECT CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE event_type IS NULL)"
    f" AS BIGINT) AS total_missing FROM {EVENTS_MISSING}"
)
def total_missing(t: Tables) -> DataFrame:
    return prof.total_missing(t.events_missing)


@query(
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)"""
)
def profile_duplicates(t: Tables) -> DataFrame:
    """Copies of a text in a language."""
    return prof.duplicate_rows(t.documents.select("text", "lang"))


@query(
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n
    FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus)"""
)
def duplicates_many(t: Tables) -> DataFrame:
    """A projection in which most rows have an equal one."""
    return prof.duplicate_rows(
        t.lineitem.select("l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    )


@query(
    _each(LINE_NUMBERS, """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
      round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75,
      CAST(max({c}) AS DOUBLE) AS max FROM lineitem""")
)
def describe_numeric(t: Tables) -> DataFrame:
    return rounded(prof.describe_numeric(t.lineitem))


_CATEGORICAL = """SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  (array_agg(v ORDER BY n DESC, v))[1] AS top, max(n) AS freq
  FROM (SELECT {c} AS v, count(*) AS n FROM {{table}} WHERE {c} IS NOT NULL GROUP BY {c})"""


@query(_each(("o_orderstatus", "o_orderpriority"), _CATEGORICAL).replace("{table}", "orders"))
def describe_categorical(t: Tables) -> DataFrame:
    return prof.describe_categorical(t.orders)


_ALL_KINDS = """SELECT "column", count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min,
  round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(max, 4) AS max, "unique", top, freq, first, last FROM ("""
_NO_NUMBERS = "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max"
_NO_NAMES = "NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq"
_ORDERS_FLAGGED = "(SELECT *, o_orderstatus = 'F' AS finished FROM orders)"


@query(
    _ALL_KINDS
    + _each(("o_orderkey", "o_custkey", "o_totalprice"), """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
      CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
      quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max, """ + _NO_NAMES + """,
      NULL::VARCHAR AS first, NULL::VARCHAR AS last FROM orders""")
    + " UNION ALL "
    + _each(("o_orderstatus", "o_orderpriority", "finished"), """SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, """ + _NO_NUMBERS + """,
      count(*) AS "unique", (array_agg(v ORDER BY n DESC, v))[1] AS top, max(n) AS freq, NULL::VARCHAR AS first, NULL::VARCHAR AS last
      FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM """ + _ORDERS_FLAGGED + """ WHERE {c} IS NOT NULL GROUP BY {c})""")
    + """ UNION ALL SELECT 'o_orderdate' AS "column", count(o_orderdate) AS count, """ + _NO_NUMBERS + ", " + _NO_NAMES + """,
      CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last FROM orders)"""
)
def describe_all(t: Tables) -> DataFrame:
    """Numbers, text, a boolean and a timestamp in one table."""
    return rounded(prof.describe(t.orders.withColumn("finished", F.col("o_orderstatus") == "F")))


@query(
    f"""SELECT event_type AS value, count(*) AS count,
      round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS share
    FROM {EVENTS_MISSING} WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def class_distribution(t: Tables) -> DataFrame:
    return prof.class_distribution(t.events_missing, "event_type")


_TASK_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")


@query(
    _each(_TASK_COLUMNS, """SELECT '{c}' AS "column",
      CASE WHEN count(DISTINCT {c}) <= 20 THEN count(DISTINCT {c}) END AS distinct_values,
      CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS task
      FROM lineitem""")
    + """ UNION ALL SELECT 'l_returnflag', CASE WHEN count(DISTINCT l_returnflag) <= 20
      THEN count(DISTINCT l_returnflag) END, 'classification' FROM lineitem"""
)
def detect_task(t: Tables) -> DataFrame:
    return prof.detect_task_type(t.lineitem, [*_TASK_COLUMNS, "l_returnflag"])


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "discounted", "known_tax", "always_three")
_CORR_TABLE = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS discounted,
  CASE WHEN l_returnflag <> 'N' THEN l_tax END AS known_tax,
  CAST(3.0 AS DOUBLE) AS always_three FROM lineitem)"""


@query(
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_i, '{b}' AS col_j,
        round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 4) AS r FROM {_CORR_TABLE}"""
        for a in _CORR for b in _CORR
    )
)
def correlation_matrix(t: Tables) -> DataFrame:
    """With a column that has missing values and one that is constant."""
    wide = t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("discounted"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("known_tax"),
        F.lit(3.0).alias("always_three"),
    )
    return rounded(prof.correlation(wide))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def preview(t: Tables) -> DataFrame:
    """The first 50 orders by key."""
    return ranking.top_k(t.orders, [F.col("o_orderkey")], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_sorted(t: Tables) -> DataFrame:
    return ranking.top_k(
        t.orders.select("o_orderkey", "o_totalprice"),
        [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20,
    )


@query(
    """SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT c_nationkey, c_custkey, c_acctbal,
      CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER)
      AS rank FROM customer) WHERE rank <= 5"""
)
def topk_per_group(t: Tables) -> DataFrame:
    return ranking.top_k_per_group(
        t.customer.select("c_nationkey", "c_custkey", "c_acctbal"),
        ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5,
    )


@query(
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position
    FROM orders"""
)
def row_ordinal(t: Tables) -> DataFrame:
    return ranking.with_ordinal(
        t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]
    )


@query(
    "SELECT * FROM (SELECT '*' AS \"column\", unnest(['row_count', 'features', 'duplicate_rows']) AS metric,"
    " unnest([CAST(count(*) AS DOUBLE), 5.0, CAST(0 AS DOUBLE)]) AS value FROM customer)"
    + "".join(
        f""" UNION ALL SELECT '{c}', unnest(['missing', 'missing_percent']), unnest([CAST(0 AS DOUBLE), 0.0])"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
    + "".join(
        f""" UNION ALL SELECT '{c}', unnest(['mean', 'std', 'min', 'max', 'median']),
        unnest([round(avg({c}), 4), round(stddev_samp({c}), 4), CAST(min({c}) AS DOUBLE),
        CAST(max({c}) AS DOUBLE), round(median(CAST({c} AS DOUBLE)), 4)]) FROM customer"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    )
)
def full_profile(t: Tables) -> DataFrame:
    """Everything about the customer table, in long form."""
    return rounded(prof.profile(t.customer))
