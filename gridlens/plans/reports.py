"""Insight, file, export and data model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import evaluate, insights
from gridlens.operators import profile as prof
from gridlens.plans.registry import (
    CLASS_PREDICTIONS,
    EVENTS_MISSING,
    PRICE_PREDICTIONS,
    Tables,
    query,
    rounded,
)
from gridlens.session import new_path
from gridlens.sources import export, files
from gridlens.sources.tables import TABLES


@query(
    f"""WITH e AS (SELECT * FROM {EVENTS_MISSING}), v AS (SELECT count(*) AS n,
      count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE event_type IS NULL) AS m,
      corr(event_id, user_id) AS a, corr(event_id, value) AS b, corr(user_id, value) AS c FROM e)
    SELECT 'row_count' AS fact, '*' AS subject, CAST(n AS DOUBLE) AS value FROM v
    UNION ALL SELECT 'features', '*', 5.0::DOUBLE
    UNION ALL SELECT 'missing_percent', '*', round(m * 100.0::DOUBLE / (n * 5), 2) FROM v
    UNION ALL SELECT 'duplicate_rows', '*', CAST(0 AS DOUBLE)
    UNION ALL SELECT 'strongest_correlation', CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c)
        THEN 'event_id / user_id' WHEN abs(b) >= abs(c) THEN 'event_id / value' ELSE 'user_id / value' END,
      round(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END, 4)
    FROM v"""
)
def general_insights(t: Tables) -> DataFrame:
    return rounded(insights.general_insights(t.events_missing))


@query(
    """WITH p AS (SELECT date_trunc('month', o_orderdate) AS period, count(o_totalprice) AS n,
      sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM p)
    SELECT strftime(period, '%Y-%m-%d') AS period, n, round(total, 2) AS total, round(mean, 2) AS mean,
      round(total - lag(total) OVER (ORDER BY period), 2) AS change,
      round((SELECT regr_slope(total, i) FROM i), 2) AS slope FROM i"""
)
def trends(t: Tables) -> DataFrame:
    months = insights.trends(t.orders, "o_orderdate", "o_totalprice")
    return rounded(months.withColumn("period", F.date_format("period", "yyyy-MM-dd")), 2)


@query(
    """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
      avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
    SELECT event_id, e.event_type, value, round((value - m) / s, 4) AS z,
      NOT value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS outside_fences,
      abs((value - m) / s) > 3 AS extreme_z
    FROM events e JOIN f ON e.event_type = f.event_type
    WHERE NOT value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)
      OR abs((value - m) / s) > 3"""
)
def anomalies(t: Tables) -> DataFrame:
    found = insights.anomalies(
        t.events.select("event_id", "event_type", "value"), "value", ["event_type"]
    )
    return rounded(found)


_ADVICE = """(SELECT lang, source, n_chars, quality, toxic, n_chars * 2 AS doubled, 'v1' AS version
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    f"""WITH a AS (SELECT * FROM {_ADVICE}), n AS (SELECT count(*) AS n FROM a),
    m AS (SELECT unnest(['quality', 'toxic']) AS subject, unnest([count(*) FILTER (WHERE quality IS NULL),
      count(*) FILTER (WHERE toxic IS NULL)]) AS c FROM a),
    c AS (SELECT corr(n_chars, doubled) AS r FROM a)
    SELECT 'missing_values' AS rule, subject, round(c * 100.0::DOUBLE / n, 2) AS value FROM m, n
      WHERE c * 100.0 / n > 5
    UNION ALL SELECT 'duplicate_rows', '*', CAST(sum(k - 1) AS DOUBLE) FROM (SELECT count(*) AS k FROM a
      GROUP BY ALL HAVING true) HAVING sum(k - 1) > 0
    UNION ALL SELECT 'constant_column', 'version', 1.0::DOUBLE
    UNION ALL SELECT 'high_correlation', 'doubled / n_chars', round(r, 4) FROM c WHERE abs(r) > 0.9
    UNION ALL SELECT 'rare_class', 'source = ' || source, round(count(*)::DOUBLE / n, 4) FROM a, n
      GROUP BY source, n HAVING count(*)::DOUBLE / n < 0.1
    UNION ALL SELECT 'rare_class', 'lang = ' || lang, round(count(*)::DOUBLE / n, 4) FROM a, n
      GROUP BY lang, n HAVING count(*)::DOUBLE / n < 0.1""".replace(
        "(SELECT count(*) AS k FROM a\n      GROUP BY ALL HAVING true)",
        "(SELECT count(*) AS k FROM a GROUP BY lang, source, n_chars, quality, toxic, doubled, version)",
    )
)
def recommendations(t: Tables) -> DataFrame:
    wide = t.rated.select(
        "lang", "source", "n_chars", "quality", "toxic", (F.col("n_chars") * 2).alias("doubled"),
        F.lit("v1").alias("version"),
    )
    return rounded(insights.recommendations(wide, ["source", "lang"]))


@query(
    f"""SELECT 'metrics' AS section, unnest(['rmse', 'r2_score']) AS key, unnest([
      CAST(round(sqrt(avg((o_totalprice - predicted) ** 2)), 2) AS VARCHAR),
      CAST(round(1 - avg((o_totalprice - predicted) ** 2) / var_pop(o_totalprice), 4) AS VARCHAR)]) AS value
      FROM {PRICE_PREDICTIONS}
    UNION ALL SELECT 'profile', 'region.missing', '0.0'
    UNION ALL SELECT 'profile', 'region.rows', CAST(count(*) AS VARCHAR) || '.0' FROM orders
    UNION ALL SELECT 'model', 'model_name', 'linear rule' UNION ALL SELECT 'model', 'task_type', 'regression'"""
)
def report(t: Tables) -> DataFrame:
    one_row = evaluate.regression_metrics(t.price_predictions, "o_totalprice", "predicted")
    metrics = one_row.select(
        F.expr("stack(2, 'rmse', round(rmse, 2), 'r2_score', round(r2_score, 4))").alias("metric", "value")
    )
    facts = t.orders.agg(
        F.count_if(F.col("o_totalprice").isNull()).cast("double").alias("m"),
        F.count("*").cast("double").alias("n"),
    ).select(F.lit("region").alias("column"), F.expr("stack(2, 'missing', m, 'rows', n)").alias("metric", "value"))
    return insights.analysis_report(
        facts, metrics, {"model_name": "linear rule", "task_type": "regression"}
    )


_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"""


@query(
    f"""SELECT c.table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {_TYPES} AS type,
      row_count, ordinal_position = 1 AS is_primary_key
    FROM (SELECT table_name, column_name, data_type, row_number() OVER
        (PARTITION BY table_name ORDER BY ordinal_position) AS ordinal_position
      FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{n}'" for n in TABLES)})) c
    JOIN ({' UNION ALL '.join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES)}) r
    ON c.table_name = r.table_name"""
)
def data_model(t: Tables) -> DataFrame:
    return export.model_columns({n: getattr(t, n) for n in TABLES}).drop("created_at")


@query(
    f"""SELECT 'Machine Learning' AS metric_category, 'accuracy' AS metric_name,
      CAST(round(avg(CAST(quality = pred AS DOUBLE)), 4) AS VARCHAR) AS metric_value,
      round(avg(CAST(quality = pred AS DOUBLE)), 4) AS metric_value_num FROM {CLASS_PREDICTIONS}
    UNION ALL SELECT 'Deep Learning', 'device', 'cpu', NULL
    UNION ALL SELECT 'Data Summary', 'row_count', CAST(count(*) AS VARCHAR), CAST(count(*) AS DOUBLE)
      FROM documents"""
)
def metric_rows(t: Tables) -> DataFrame:
    accuracy = evaluate.accuracy_f1(t.class_predictions, "quality", "pred").first()["accuracy"]
    return export.analysis_results(
        t.spark, {"accuracy": accuracy}, {"device": "cpu"}, prof.table_size(t.documents)
    ).drop("timestamp")


@query(
    f"""SELECT unnest(['rmse', 'mae']) AS metric, unnest([round(sqrt(avg((o_totalprice - predicted) ** 2)), 3),
      round(avg(abs(o_totalprice - predicted)), 3)]) AS value FROM {PRICE_PREDICTIONS}"""
)
def dashboard_metrics(t: Tables) -> DataFrame:
    one_row = evaluate.regression_metrics(t.price_predictions, "o_totalprice", "predicted")
    long = one_row.select(
        F.expr("stack(3, 'rmse', rmse, 'mae', mae, 'note', cast(null as double))").alias("metric", "value")
    )
    return rounded(export.dashboard_tables({"metrics": long})["metrics_summary"], 3)


@query(
    "SELECT t || '.parquet' AS file, 'unknown' AS kind FROM (SELECT unnest(["
    + ", ".join(f"'{n}'" for n in TABLES) + "]) AS t)"
)
def file_catalog(t: Tables) -> DataFrame:
    listed = files.file_catalog(t.spark, t.folder)
    return listed.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "kind")


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders"""
)
def csv_round_trip(t: Tables) -> DataFrame:
    """Written as CSV, read back with inferred types."""
    out = export.Exporter(t.spark, new_path(t.spark, "csv"))
    path = out.to_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), "orders")
    loaded, _ = files.auto_load(t.spark, path)
    return loaded.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_all_columns(t: Tables) -> DataFrame:
    """Every column of the orders as CSV and back, by a schema and in splits."""
    out = export.Exporter(t.spark, new_path(t.spark, "csv"))
    schema = ", ".join(f"{name} {kind}" for name, kind in t.orders.dtypes)
    return files.auto_load(t.spark, out.to_csv(t.orders, "orders"), schema, multi_line=False)[0]


@query(
    """SELECT 'nation.csv' AS name, 'csv' AS kind, count(*) AS rows FROM nation
    UNION ALL SELECT 'supplier.json', 'json', count(*) FROM supplier
    UNION ALL SELECT 'customer.txt', 'text', count(*) FROM customer
    UNION ALL SELECT 'region.parquet', 'unknown', count(*) FROM region"""
)
def catalog_of_exports(t: Tables) -> DataFrame:
    """Kinds in the catalogue of written tables, beside the rows read back from each."""
    out = export.Exporter(t.spark, new_path(t.spark, "catalog"))
    read = {
        "nation.csv": files.read_csv(t.spark, out.to_csv(t.nation, "nation")),
        "supplier.json": files.read_json(t.spark, out.to_json(t.supplier, "supplier"), lines=True),
        "region.parquet": t.spark.read.parquet(out.to_parquet(t.region, "region")),
    }
    names = f"{out.folder}/customer.txt"
    t.customer.select("c_name").write.text(names)
    read["customer.txt"] = t.spark.read.text(names)
    counts = None
    for name, df in read.items():
        part = df.agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    listed = files.file_catalog(t.spark, f"{out.folder}/*")
    kinds = listed.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), "kind").distinct()
    return kinds.join(counts, "name").select("name", "kind", "rows")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(t: Tables) -> DataFrame:
    out = export.Exporter(t.spark, new_path(t.spark, "json"))
    path = out.to_json(t.conversations, "conversations")
    schema = "conv_id bigint, turn bigint, role string, text string"
    return files.read_json(t.spark, path, schema, lines=True)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_round_trip(t: Tables) -> DataFrame:
    out = export.Exporter(t.spark, new_path(t.spark, "parquet"))
    return files.auto_load(t.spark, out.to_parquet(t.part, "part"))[0]


@query("SELECT CAST(sum(length(c_name)) AS BIGINT) AS chars, count(*) AS lines FROM customer")
def text_files(t: Tables) -> DataFrame:
    """Names written as text files, each file read as one text."""
    path = new_path(t.spark, "text") + "/names.txt"
    t.customer.select("c_name").write.text(path)
    whole, _ = files.auto_load(t.spark, path)
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return whole.select(
        F.size(lines).cast("long").alias("n"),
        F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("c"),
    ).agg(F.sum("c").alias("chars"), F.sum("n").alias("lines"))


@query(
    """SELECT unnest(['nation', 'nation', 'supplier', 'supplier']) AS name,
      unnest(['csv', 'parquet', 'csv', 'parquet']) AS format, unnest([1, 2, 3, 4]) AS position,
      unnest([n, n, s, s]) AS rows
    FROM (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS s)"""
)
def export_all(t: Tables) -> DataFrame:
    """The list of exports with the rows that each holds."""
    out = export.Exporter(t.spark, new_path(t.spark, "export"))
    out.export_all({"nation": t.nation, "supplier": t.supplier})
    counts = None
    for _, kind, path in out.written:
        read = files.read_csv if kind == "csv" else (lambda s, p: s.read.parquet(p))
        part = read(t.spark, path).agg(F.count("*").alias("rows")).withColumn("path", F.lit(path))
        counts = part if counts is None else counts.unionByName(part)
    return out.exported().join(counts, "path").select("name", "format", "position", "rows")


@query(
    f"""SELECT doc_id, pred AS prediction, round(CASE WHEN pred = 1 THEN 0.25 ELSE 0.75 END, 4)::DOUBLE AS prob_class_0,
      round(CASE WHEN pred = 1 THEN 0.75 ELSE 0.25 END, 4)::DOUBLE AS prob_class_1 FROM {CLASS_PREDICTIONS}"""
)
def export_predictions(t: Tables) -> DataFrame:
    scored = t.class_predictions.select(
        "doc_id", F.col("pred").alias("prediction"),
        F.when(F.col("pred") == 1, 0.25).otherwise(0.75).alias("prob_class_0"),
        F.when(F.col("pred") == 1, 0.75).otherwise(0.25).alias("prob_class_1"),
    )
    out = export.Exporter(t.spark, new_path(t.spark, "predictions"))
    schema = "doc_id bigint, prediction int, prob_class_0 double, prob_class_1 double"
    return files.read_csv(t.spark, out.predictions(scored), schema)
