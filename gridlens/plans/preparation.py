"""Cleaning, encoding and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import prep, split
from gridlens.plans.registry import EVENTS_MISSING, RATED, Tables, query, rounded

# Text of the JSON payload, a grade that is text in part, and a type.
_TEXTS = """(SELECT event_id, regexp_extract(props, '[0-9]+') AS k,
  CASE WHEN value > 50 THEN 'high' ELSE CAST(user_id AS VARCHAR) END AS grade, event_type FROM events)"""


def _texts(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        F.when(F.col("value") > 50, "high").otherwise(F.col("user_id").cast("string")).alias("grade"),
        "event_type",
    )


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(t: Tables) -> DataFrame:
    return prep.select_type(t.customer, "numeric")


@query("SELECT c_name, c_mktsegment FROM customer")
def select_categorical(t: Tables) -> DataFrame:
    return prep.select_type(t.customer, "categorical")


@query("SELECT event_id, event_type, value FROM events")
def drop_empty_columns(t: Tables) -> DataFrame:
    """A note that no event has disappears."""
    noted = t.events.select(
        "event_id", "event_type", F.when(F.col("value") < 0, F.lit("negative")).alias("note"), "value"
    )
    return prep.drop_empty_columns(noted)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def features_without_target(t: Tables) -> DataFrame:
    return prep.split_features_target(t.customer, "c_mktsegment")[0]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "values",
        count(*) FILTER (WHERE NOT regexp_matches({c}, '^[0-9]+$')) AS unparsable,
        count(*) FILTER (WHERE NOT regexp_matches({c}, '^[0-9]+$')) = 0 AS is_numeric FROM {_TEXTS}"""
        for c in ("k", "grade", "event_type")
    )
)
def numeric_text_columns(t: Tables) -> DataFrame:
    return prep.numeric_text_columns(_texts(t))


@query(f"SELECT event_id, CAST(k AS DOUBLE) AS k FROM {_TEXTS}")
def coerce_numeric(t: Tables) -> DataFrame:
    return prep.coerce_numeric(_texts(t))


@query(
    """SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
      CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders"""
)
def one_hot_drop_first(t: Tables) -> DataFrame:
    return prep.one_hot(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query(
    f"""SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {EVENTS_MISSING})), 4) AS value
    FROM {EVENTS_MISSING}"""
)
def fill_median(t: Tables) -> DataFrame:
    return rounded(prep.fill_missing(t.events_missing.select("event_id", "value"), "median"))


@query(
    f"""SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {EVENTS_MISSING})), 4) AS value
    FROM {EVENTS_MISSING}"""
)
def fill_mean(t: Tables) -> DataFrame:
    return rounded(prep.fill_missing(t.events_missing.select("event_id", "value"), "mean"))


@query(f"SELECT event_id, coalesce(value, 0) AS value FROM {EVENTS_MISSING}")
def fill_zero(t: Tables) -> DataFrame:
    return prep.fill_missing(t.events_missing.select("event_id", "value"), "zero")


@query(
    f"""SELECT event_id, coalesce(event_type, (SELECT event_type FROM {EVENTS_MISSING}
      WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type
    FROM {EVENTS_MISSING}"""
)
def fill_mode(t: Tables) -> DataFrame:
    return prep.fill_missing(t.events_missing.select("event_id", "event_type"))


@query(
    f"""SELECT doc_id, n_chars,
      coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM labels)) AS quality,
      coalesce(CAST(toxic AS DOUBLE), (SELECT median(toxic) FROM labels)) AS toxic,
      CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es,
      CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM {RATED}"""
)
def preprocess(t: Tables) -> DataFrame:
    """Documents with rare labels, language one-hot, gaps filled."""
    rated = t.rated.select("doc_id", "lang", "n_chars", "quality", "toxic")
    out = prep.preprocess(rated, drop_non_numeric=False)
    return out.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})


@query(
    """SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code
    FROM customer"""
)
def label_encode(t: Tables) -> DataFrame:
    return prep.label_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS code FROM customer")
def label_codes_many(t: Tables) -> DataFrame:
    """A class per customer: as many codes as rows."""
    return prep.label_codes(t.customer, "c_name")


@query(f"SELECT event_id, CAST(event_type IS NULL AS INTEGER) AS untyped FROM {EVENTS_MISSING}")
def bool_to_int(t: Tables) -> DataFrame:
    flagged = t.events_missing.select("event_id", F.col("event_type").isNull().alias("untyped"))
    return prep.booleans_to_int(flagged)


@query(
    f"""WITH f AS (SELECT event_id, coalesce(value, (SELECT median(value) FROM {EVENTS_MISSING})) AS v,
      CAST(user_id AS DOUBLE) AS u FROM {EVENTS_MISSING}),
    s AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(u) AS mu, stddev_pop(u) AS su FROM f)
    SELECT event_id, round((u - mu) / su, 4) AS user_id, round((v - mv) / sv, 4) AS value,
      CAST(0 AS DOUBLE) AS one FROM f, s"""
)
def impute_scale(t: Tables) -> DataFrame:
    e = t.events_missing.select("event_id", "user_id", "value", F.lit(1.0).alias("one"))
    return rounded(prep.impute_and_scale(e, ["user_id", "value", "one"]))


@query(
    """SELECT toxic AS label, count(*) AS n,
      round(CAST((SELECT count(*) FROM labels) AS DOUBLE) /
        ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight
    FROM labels GROUP BY toxic"""
)
def class_weights(t: Tables) -> DataFrame:
    return rounded(prep.class_weights(t.labels, "toxic"), 6)


_ORDER = """row_number() OVER (PARTITION BY {label} ORDER BY md5(concat(CAST({id} AS VARCHAR), '|42')), {id})"""


@query(
    f"""SELECT doc_id, quality, rn <= greatest(1, round(0.2 * n)) AS is_test FROM (
      SELECT doc_id, quality, {_ORDER.format(label='quality', id='doc_id')} AS rn,
        count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
)
def stratified_split(t: Tables) -> DataFrame:
    return split.train_test_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query(
    """SELECT o_orderkey, rn <= greatest(1, round(0.25 * n)) AS is_test FROM (SELECT o_orderkey,
      row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|42')), o_orderkey) AS rn,
      count(*) OVER () AS n FROM orders)"""
)
def random_split(t: Tables) -> DataFrame:
    return split.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", test_size=0.25)


@query(
    f"""SELECT o_orderkey, o_orderstatus,
      CAST(({_ORDER.format(label='o_orderstatus', id='o_orderkey')} - 1) % 5 AS INTEGER) AS fold FROM orders"""
)
def kfold_assign(t: Tables) -> DataFrame:
    return split.kfold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
