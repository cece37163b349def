"""Evaluation queries on predictions that need no model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridlens.operators import evaluate
from gridlens.operators.split import kfold
from gridlens.plans.registry import (
    CLASS_PREDICTIONS,
    PRICE_PREDICTIONS,
    Tables,
    query,
    rounded,
)

_PER_CLASS = f"""c AS (SELECT k.label,
    count(*) FILTER (WHERE quality = k.label AND pred = k.label) AS tp,
    count(*) FILTER (WHERE quality = k.label) AS support,
    count(*) FILTER (WHERE pred = k.label) AS predicted
  FROM {CLASS_PREDICTIONS} p, (SELECT DISTINCT quality AS label FROM labels) k GROUP BY k.label),
m AS (SELECT CAST(label AS VARCHAR) AS label, tp, support,
    coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision,
    coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp::DOUBLE / nullif(support + predicted, 0), 0) AS f1 FROM c)"""


@query(
    f"""WITH {_PER_CLASS} SELECT round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy,
      round(sum(f1 * support) / sum(support), 4) AS f1_score FROM m"""
)
def accuracy_f1(t: Tables) -> DataFrame:
    return evaluate.accuracy_f1(t.class_predictions, "quality", "pred")


@query(
    f"""SELECT CAST(a.label AS VARCHAR) AS actual, CAST(b.label AS VARCHAR) AS predicted,
      count(p.doc_id) AS count,
      round(count(p.doc_id) / (sum(count(p.doc_id)) OVER (PARTITION BY a.label) + 1e-9::DOUBLE), 4) AS share
    FROM (SELECT DISTINCT quality AS label FROM labels) a
    CROSS JOIN (SELECT DISTINCT quality AS label FROM labels) b
    LEFT JOIN {CLASS_PREDICTIONS} p ON p.quality = a.label AND p.pred = b.label
    GROUP BY a.label, b.label"""
)
def confusion(t: Tables) -> DataFrame:
    return rounded(evaluate.confusion_matrix(t.class_predictions, "quality", "pred", ["0", "1"]))


@query(
    f"""WITH {_PER_CLASS} SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
      round(f1, 4) AS f1, support FROM m
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 4),
      CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
      CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
      round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
      CAST(sum(support) AS BIGINT) FROM m"""
)
def class_report(t: Tables) -> DataFrame:
    return evaluate.classification_report(t.class_predictions, "quality", "pred")


_AUC = """SELECT round((sum(CASE WHEN {y} THEN r END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS roc_auc
  FROM (SELECT *, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS r,
    CAST(count(*) FILTER (WHERE {y}) OVER () AS DOUBLE) AS n1,
    CAST(count(*) FILTER (WHERE NOT {y}) OVER () AS DOUBLE) AS n0 FROM {t}) GROUP BY n1, n0"""


@query(_AUC.format(y="quality = 1", s="n_chars", t=CLASS_PREDICTIONS))
def roc_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.roc_auc(t.class_predictions, "quality", "n_chars"), 6)


@query(_AUC.format(y="l_returnflag = 'R'", s="l_quantity", t="lineitem"))
def roc_auc_ties(t: Tables) -> DataFrame:
    """Fifty distinct scores over all line items."""
    df = t.lineitem.selectExpr("cast(l_returnflag = 'R' as int) as y", "l_quantity")
    return rounded(evaluate.roc_auc(df, "y", "l_quantity"), 6)


@query(
    f"""SELECT round(avg((o_totalprice - predicted) ** 2), 0) AS mse,
      round(sqrt(avg((o_totalprice - predicted) ** 2)), 3) AS rmse,
      round(avg(abs(o_totalprice - predicted)), 3) AS mae,
      round(1 - avg((o_totalprice - predicted) ** 2) / var_pop(o_totalprice), 6) AS r2_score
    FROM {PRICE_PREDICTIONS}"""
)
def regression_metrics(t: Tables) -> DataFrame:
    out = evaluate.regression_metrics(t.price_predictions, "o_totalprice", "predicted")
    return rounded(out, 3, mse=0, r2_score=6)


_FOLDS = f"""(SELECT fold, avg(CAST(quality = pred AS DOUBLE)) AS score FROM (SELECT *,
  (row_number() OVER (PARTITION BY quality ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42')), doc_id) - 1)
    % 5 AS fold FROM {CLASS_PREDICTIONS}) GROUP BY fold)"""


@query(f"SELECT round(avg(score), 4) AS cv_mean, round(stddev_pop(score), 4) AS cv_std FROM {_FOLDS}")
def cv_scores(t: Tables) -> DataFrame:
    dealt = kfold(t.class_predictions, "doc_id", "quality")
    return evaluate.cv_summary(evaluate.fold_scores(dealt, "classification", "quality", "pred"))


@query(
    f"""SELECT CAST(fold AS INTEGER) AS fold, round(1 - avg((o_totalprice - predicted) ** 2) /
      var_pop(o_totalprice), 6) AS score FROM (SELECT *, (row_number() OVER
        (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|42')), o_orderkey) - 1) % 5 AS fold
      FROM {PRICE_PREDICTIONS}) GROUP BY fold"""
)
def fold_r2(t: Tables) -> DataFrame:
    dealt = kfold(t.price_predictions, "o_orderkey")
    return rounded(evaluate.fold_scores(dealt, "regression", "o_totalprice", "predicted"), 6)
