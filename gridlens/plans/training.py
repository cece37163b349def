"""Model queries at the operators' sizes, with five folds.  A run returns facts that
SQL can state: the rows of the split, whether the model beats a constant guess in the
held-out rows and in every fold, whether its scores are proper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import evaluate, insights, models
from gridlens.operators import profile as prof
from gridlens.operators.split import kfold
from gridlens.plans.registry import QUERIES, Tables, query
from gridlens.session import materialise, new_path
from gridlens.sources import export, files

FOLDS = 5
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_NET = "l_quantity * (1 - l_discount)"


def _items(t: Tables, target: str) -> DataFrame:
    """All line items: five features and a target that they determine."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return t.lineitem.select(key.alias("id"), *FEATURES, F.expr(target).alias("y"))


def _keyed_items(t: Tables, target: str) -> DataFrame:
    return t.lineitem.select(*KEYS, *FEATURES, F.expr(target).alias("y"))


TWO_CLASSES = f"case when {_NET} > 25 then 'large' else 'small' end"
THREE_CLASSES = f"case when {_NET} < 16 then 'low' when {_NET} < 32 then 'mid' else 'top' end"


def _classify(t: Tables, model: str, target: str = TWO_CLASSES) -> DataFrame:
    run = models.train(_items(t, target), "y", "id", model, "classification", folds=FOLDS)
    shares = [F.col(f"prob_class_{i}") for i in range(len(run.model.labels))]
    share = _items(t, target).groupBy("y").count().agg(F.max("count") / F.sum("count")).first()[0]
    accuracy = run.metrics.where("metric = 'accuracy'").select("value").scalar()
    by_class = run.predictions.groupBy("y").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("prediction") == F.col("y")).alias("hits"),
        F.bool_and(F.abs(sum(shares[1:], shares[0]) - 1) < 1e-6).alias("proper"),
    )
    return by_class.agg(
        F.sum("n").alias("test_rows"), F.count("*").alias("classes"), F.max("n").alias("largest_class"),
        F.bool_and("proper").alias("probabilities_sum_to_one"), F.sum("hits").alias("hits"),
    ).select(
        "test_rows", "classes", "largest_class", "probabilities_sum_to_one",
        (F.col("hits") > F.col("largest_class")).alias("beats_majority"),
        (F.abs(F.col("hits") / F.col("test_rows") - accuracy) < 1e-4).alias("accuracy_agrees"),
        F.lit(run.folds.where(F.col("score") > F.lit(share)).count()).cast("long").alias("folds_beating_majority"),
    )


def _classify_sql(target: str) -> str:
    return f"""WITH c AS (SELECT {target} AS y, count(*) AS n FROM lineitem GROUP BY 1),
      s AS (SELECT greatest(1, CAST(round(n * 0.2) AS BIGINT)) AS n FROM c)
    SELECT CAST(sum(n) AS BIGINT) AS test_rows, count(*) AS classes, max(n) AS largest_class,
      TRUE AS probabilities_sum_to_one, TRUE AS beats_majority, TRUE AS accuracy_agrees,
      CAST({FOLDS} AS BIGINT) AS folds_beating_majority FROM s"""


def _regress(t: Tables, model: str) -> DataFrame:
    run = models.train(_items(t, _NET), "y", "id", model, "regression", folds=FOLDS)
    r2 = run.metrics.where("metric = 'r2_score'").select("value").scalar()
    error = F.col("y") - F.col("prediction")
    return run.predictions.agg(
        F.count("*").alias("test_rows"), F.count("prediction").alias("n"),
        F.avg(error * error).alias("mse"), F.var_pop("y").alias("variance"),
    ).select(
        "test_rows", (F.col("n") == F.col("test_rows")).alias("all_predicted"),
        (F.col("mse") < F.col("variance")).alias("beats_mean"),
        (F.abs(1 - F.col("mse") / F.col("variance") - r2) < 1e-4).alias("r2_agrees"),
        F.lit(run.folds.where("score > 0").count()).cast("long").alias("folds_beating_mean"),
    )


_REGRESS_SQL = f"""SELECT greatest(1, CAST(round(count(*) * 0.2) AS BIGINT)) AS test_rows,
  TRUE AS all_predicted, TRUE AS beats_mean, TRUE AS r2_agrees, CAST({FOLDS} AS BIGINT) AS folds_beating_mean FROM lineitem"""


def _register(name: str, build, sql: str) -> None:
    build.__name__ = name
    query(sql)(build)


for _model in models.CLASSIFIERS:
    _register(f"train_{_model.lower().replace(' ', '_')}_classes", lambda t, m=_model: _classify(t, m),
              _classify_sql(TWO_CLASSES))
for _model in models.REGRESSORS:
    _register(f"train_{_model.lower().replace(' ', '_')}_numbers", lambda t, m=_model: _regress(t, m),
              _REGRESS_SQL)


@query(_classify_sql(THREE_CLASSES))
def train_three_classes(t: Tables) -> DataFrame:
    """Softmax trees: one per class and round."""
    return _classify(t, "Gradient Boosting", THREE_CLASSES)


@query(
    f"""WITH c AS (SELECT {TWO_CLASSES} AS y, count(*) AS n FROM lineitem GROUP BY 1),
      f AS (SELECT unnest(range({FOLDS})) AS fold)
    SELECT CAST(fold AS INTEGER) AS fold, TRUE AS beats_majority,
      CAST(sum(n // {FOLDS} + CASE WHEN fold < n % {FOLDS} THEN 1 ELSE 0 END) AS BIGINT) AS n
    FROM c, f GROUP BY fold"""
)
def cross_validated(t: Tables) -> DataFrame:
    """Every fold with its rows, and whether the model fitted on the others beats the majority."""
    dealt = materialise(kfold(_items(t, TWO_CLASSES), "id", "y", FOLDS), "folds")
    scores = models.cross_validate(dealt, "y", "Logistic Regression", "classification", FEATURES, FOLDS, None)
    classes = dealt.groupBy("y").agg(F.count("*").alias("n"))
    share = classes.agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    return dealt.groupBy("fold").agg(F.count("*").alias("n")).join(scores, "fold").select(
        "fold", "n", (F.col("score") > share).alias("beats_majority"))


@query(
    f"""WITH c AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT unnest(range({FOLDS})) AS fold)
    SELECT CAST(fold AS INTEGER) AS fold, TRUE AS beats_mean,
      CAST(n // {FOLDS} + CASE WHEN fold < n % {FOLDS} THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, f"""
)
def cross_validated_numbers(t: Tables) -> DataFrame:
    """Every fold with its rows, and whether the model fitted on the others beats the mean."""
    dealt = materialise(kfold(_items(t, _NET), "id", None, FOLDS), "folds")
    scores = models.cross_validate(dealt, "y", "Ridge Regression", "regression", FEATURES, FOLDS, None)
    return dealt.groupBy("fold").agg(F.count("*").alias("n")).join(scores, "fold").select(
        "fold", "n", (F.col("score") > 0).alias("beats_mean"))


_IMPORTANCE_SQL = """SELECT feature, feature = 'l_quantity' AS largest, 1.0::DOUBLE AS total FROM (
    SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature
    UNION SELECT 'l_returnflag_' || l_returnflag FROM lineitem
      WHERE l_returnflag > (SELECT min(l_returnflag) FROM lineitem)
    UNION SELECT 'l_linestatus_' || l_linestatus FROM lineitem
      WHERE l_linestatus > (SELECT min(l_linestatus) FROM lineitem))"""


def _importance(data: DataFrame, model: str, task: str) -> DataFrame:
    """Every feature, whether it is the most important, and the sum over all features."""
    found = models.fit(data, "y", model, task).importance(data)
    return found.select(
        "feature",
        (F.col("importance") == found.agg(F.max("importance").alias("m")).scalar()).alias("largest"),
        F.round(found.agg(F.sum("importance").alias("s")).scalar(), 6).alias("total"),
    )


@query(_IMPORTANCE_SQL)
def feature_importance(t: Tables) -> DataFrame:
    return _importance(_items(t, TWO_CLASSES).drop("id"), "Random Forest", "classification")


@query(_IMPORTANCE_SQL)
def ensemble_importance(t: Tables) -> DataFrame:
    return _importance(_items(t, _NET).drop("id"), "Ensemble", "regression")


SHIPPED = "case when l_returnflag = 'N' then 'open' else 'closed' end"


@query(f"SELECT {', '.join(KEYS)}, {SHIPPED} AS y, {SHIPPED} AS prediction FROM lineitem")
def predict_table(t: Tables) -> DataFrame:
    """All line items with their predicted class, which one category decides."""
    data = _keyed_items(t, SHIPPED)
    fitted = models.fit(data, "y", "Logistic Regression", "classification", FEATURES)
    return fitted.predict(data).select(*KEYS, "y", "prediction")


@query(f"SELECT {', '.join(KEYS)}, 1.0::DOUBLE AS total, TRUE AS likeliest FROM lineitem")
def predict_probabilities(t: Tables) -> DataFrame:
    """All line items: the sum of the class probabilities, and whether the predicted class has the largest."""
    data = _keyed_items(t, THREE_CLASSES)
    fitted = models.fit(data, "y", "Random Forest", "classification", FEATURES)
    shares = [F.col(f"prob_class_{i}") for i in range(len(fitted.labels))]
    place = F.array_position(F.lit(fitted.labels), F.col("prediction")).cast("int") - 1
    return fitted.predict_proba(data).select(
        *KEYS, F.round(sum(shares[1:], shares[0]), 6).alias("total"),
        (F.get(F.array(*shares), place) == F.greatest(*shares)).alias("likeliest"))


_ONE_FEATURE = """WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx,
    avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
  c AS (SELECT sum((l_quantity - mx) / sx * (l_extendedprice - my)) AS sxy, any_value(n) AS n,
    any_value(my) AS my FROM lineitem, s)"""


def _one_feature(t: Tables, model: str, alpha: float) -> DataFrame:
    data = t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("y"))
    fitted = models.fit(data, "y", model, "regression", alpha=alpha)
    line = fitted.members[0].model
    return fitted.predict(data).agg(
        F.count("*").alias("n"),
        F.round(F.lit(float(line.coefficients[0])), 3).alias("coefficient"),
        F.round(F.lit(float(line.intercept)), 3).alias("intercept"),
        F.round(F.avg("prediction"), 3).alias("mean_prediction"),
    )


@query(
    f"""{_ONE_FEATURE} SELECT n, round(sxy / (n + 1.0::DOUBLE), 3) AS coefficient, round(my, 3) AS intercept,
      round(my, 3) AS mean_prediction FROM c"""
)
def ridge_one_feature(t: Tables) -> DataFrame:
    """Closed form: Sxy / (Sxx + alpha) on the scaled feature, where Sxx = n."""
    return _one_feature(t, "Ridge Regression", 1.0)


@query(
    f"""{_ONE_FEATURE} SELECT n, round(sign(sxy) * greatest(abs(sxy) / n - 1.0::DOUBLE, 0), 3) AS coefficient,
      round(my, 3) AS intercept, round(my, 3) AS mean_prediction FROM c"""
)
def lasso_one_feature(t: Tables) -> DataFrame:
    """Closed form: soft threshold of the mean product."""
    return _one_feature(t, "Lasso Regression", 1.0)


_TWO_FEATURES = """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2,
      stddev_pop(l_discount) AS s2, avg(l_extendedprice) AS my, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - m1) / s1 AS a, (l_discount - m2) / s2 AS b,
      l_extendedprice - my AS y, my, n FROM lineitem, s),
    g AS (SELECT sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, any_value(n) + 1.0::DOUBLE AS d FROM x),
    c AS (SELECT (ay * d - yb * ab) / (d * d - ab * ab) AS p, (yb * d - ay * ab) / (d * d - ab * ab) AS q FROM g)"""


def _ridge(t: Tables) -> tuple[DataFrame, models.FittedModel]:
    data = t.lineitem.select(*KEYS, "l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    return data, models.fit(data, "y", "Ridge Regression", "regression", ["l_quantity", "l_discount"])


@query(f"{_TWO_FEATURES} SELECT l_orderkey, l_linenumber, l_partkey, round(my + p * a + q * b, 3) AS prediction FROM x, c")
def ridge_predictions(t: Tables) -> DataFrame:
    """Every line item with its prediction; closed form of two features."""
    data, fitted = _ridge(t)
    return fitted.predict(data).select(*KEYS, F.round("prediction", 3).alias("prediction"))


_PROFILED = ("l_quantity", "l_discount", "y")
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT 'profile' AS section, '{c}.' || unnest(['missing', 'missing_percent', 'mean', 'std', 'min', 'max', 'median']) AS key,
      unnest([CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE), round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 2),
        avg({c}), stddev_samp({c}), min({c}), max({c}), median({c})]) AS number FROM v"""
    for c in _PROFILED
)


@query(
    f"""{_TWO_FEATURES}, v AS (SELECT l_quantity, l_discount, l_extendedprice AS y FROM lineitem),
    e AS (SELECT avg((y - p * a - q * b) ** 2) AS mse, var_pop(y) AS variance FROM x, c),
    facts AS ({_PROFILE_SQL}
      UNION ALL SELECT 'profile', '*.' || unnest(['row_count', 'features', 'duplicate_rows']), unnest([CAST(count(*) AS DOUBLE), 3.0::DOUBLE,
        CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS DOUBLE)]) FROM v
      UNION ALL SELECT 'metrics', unnest(['rmse', 'r2_score']), unnest([sqrt(mse), 1 - mse / variance]) FROM e)
    SELECT section, key, round(number, 4) AS number, CAST(NULL AS VARCHAR) AS text FROM facts
    UNION ALL SELECT 'model', unnest(['model_name', 'task_type']), CAST(NULL AS DOUBLE), unnest(['Ridge Regression', 'regression'])"""
)
def report_of_model(t: Tables) -> DataFrame:
    """Report from the profile of all line items and the metrics of a model fitted on them."""
    data, fitted = _ridge(t)
    errors = evaluate.regression_metrics(fitted.predict(data), "y", "prediction")
    metrics = errors.select(F.expr("stack(2, 'rmse', rmse, 'r2_score', r2_score)").alias("metric", "value"))
    facts = insights.analysis_report(
        prof.profile(data.select(*_PROFILED)), metrics, {"model_name": fitted.name, "task_type": fitted.task})
    number = F.col("value").try_cast("double")
    return facts.select("section", "key", F.round(number, 4).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query(f"SELECT {', '.join(KEYS)}, {SHIPPED} AS y, {SHIPPED} AS prediction, 1.0::DOUBLE AS total, TRUE AS likeliest FROM lineitem")
def export_model_predictions(t: Tables) -> DataFrame:
    """All line items scored by a model, exported with its class probabilities and read back."""
    data = _keyed_items(t, SHIPPED)
    fitted = models.fit(data, "y", "Logistic Regression", "classification", FEATURES)
    scored = fitted.predict_proba(data)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    back = files.read_csv(t.spark, export.Exporter(t.spark, new_path(t.spark, "predictions")).predictions(scored), schema)
    shares = [F.col(f"prob_class_{i}") for i in range(len(fitted.labels))]
    place = F.array_position(F.lit(fitted.labels), F.col("prediction")).cast("int") - 1
    return back.select(
        *KEYS, "y", "prediction", F.round(sum(shares[1:], shares[0]), 6).alias("total"),
        (F.get(F.array(*shares), place) == F.greatest(*shares)).alias("likeliest"))


__all__ = ["QUERIES"]
