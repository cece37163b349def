"""Supervised models by name on Spark ML, with one common way to score them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.columns import is_missing, quoted, require_columns
from gridlens.operators import evaluate, kernel, linear, trees
from gridlens.operators.features import FEATURES, FeatureModel, column_list, feature_columns, fit_features
from gridlens.operators.prep import with_class_weights
from gridlens.operators.profile import detect_task_type
from gridlens.operators.ranking import lookup_join
from gridlens.operators.split import split_and_folds
from gridlens.session import materialise

SEED = 42
LABEL, WEIGHT, ROWS = "_label", "_weight", "_rows"
ROWS_PER_TASK = 50_000
SIDE_BY_SIDE = 6
FOLDS_SIDE_BY_SIDE = 10
CLASSIFIERS = (
    "Random Forest", "Gradient Boosting", "Logistic Regression", "SVM", "XGBoost", "LightGBM",
    "Ensemble",
)
REGRESSORS = (
    "Random Forest", "Gradient Boosting", "Ridge Regression", "Lasso Regression", "SVM", "XGBoost",
    "LightGBM", "Ensemble",
)


# ---------------------------------------------------------------- members


@dataclass
class Member:
    """One fitted model and how to turn its output into scores."""

    model: Any
    classes: int = 0
    weights: np.ndarray | None = None

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Append class probabilities (array) or the predicted number."""
        if isinstance(self.model, linear.LinearModel):
            return df.withColumn(name, self.model.predict(FEATURES))
        if hasattr(self.model, "scores"):
            return trees.scored(df, FEATURES, self.model, name)
        out = self.model.transform(df)
        return out.select(*[quoted(c) for c in df.columns], vector_to_array("probability").alias(name))


def _tree_settings(name: str, classes: int, size: int, params: dict[str, Any]) -> trees.Boosting | trees.Forest | None:
    """The settings of a tree model by its name; `trees`, `rounds` and `depth` change them."""
    depth, none = params.get("depth"), 1 << 20
    if name == "Random Forest":
        drawn = max(1, int(size**0.5)) if classes else 0
        return trees.Forest(params.get("trees", 200), depth or none, balanced=bool(classes), per_node=drawn, seed=SEED)
    rounds = params.get("rounds")
    if name == "Gradient Boosting":
        plain = trees.Growth(depth=depth or params.get("levels", 5), penalty=0.0, least_hessian=0.0)
        return trees.Boosting(rounds or 150, 0.1, plain, by_rows=True, seed=SEED)
    if name == "XGBoost":
        share = params.get("share", 0.8)
        penalised = trees.Growth(depth=depth or 6, penalty=1.0, least_hessian=1.0, columns=share)
        return trees.Boosting(rounds or 200, params.get("rate", 0.05), penalised, row_share=share, seed=SEED)
    if name == "LightGBM":
        by_leaf = trees.Growth(depth=depth or none, leaves=31, penalty=0.0, least_hessian=1e-3, least_rows=20)
        return trees.Boosting(rounds or 200, 0.05, by_leaf, balanced=bool(classes), seed=SEED)
    return None


def _fit_trees(
    df: DataFrame, name: str, classes: int, features: FeatureModel, uses: Sequence[Column], bins: trees.Bins, params: dict[str, Any]
) -> list[Member]:
    size = len(features.names)
    setting = _tree_settings(name, classes, size, params)
    found = trees.fit_all(df, FEATURES, LABEL, features.numeric, size, classes, uses, setting, params.get("task_bytes"), bins, ROWS)
    kept = lambda m: m.trees
    return [Member(m, classes, trees.importances(kept(m), size)) for m in found]


def _fit_linear(df: DataFrame, name: str, uses: Sequence[Column], params: dict[str, Any]) -> list[Member]:
    limits = {"iterations": params["iterations"]} if "iterations" in params else {}
    kind = "ridge" if name == "Ridge Regression" else "lasso"
    found = linear.fit_all(df, FEATURES, LABEL, uses, kind, params.get("alpha", 1.0), rows=ROWS, **limits)
    return [Member(m, 0, np.abs(m.coefficients.toArray())) for m in found]


def _fit_logistic(df: DataFrame, classes: int, iterations: int = 1000, **_: Any) -> Member:
    """L2 with C = 1: Spark divides the loss by the sum of weights, which is n."""
    n = df.agg(F.sum(ROWS)).first()[0]
    estimator = LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=iterations,
        regParam=1.0 / n, standardization=False,
    )
    fitted = estimator.fit(df)
    return Member(fitted, classes, np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0))


def _fit_kernel(df: DataFrame, classes: int, uses: Sequence[Column], params: dict[str, Any]) -> list[Member]:
    # scaled columns have variance 1 and constant ones 0, so features times variance is the number of varying ones
    variance = df.where(uses[0]).select(Summarizer.variance(F.col(FEATURES)).alias("v")).first()["v"].toArray()
    gamma = 1.0 / max(1, int((variance > 1e-9).sum()))
    limits = {"iterations": params["iterations"]} if "iterations" in params else {}
    found = kernel.fit_all(df, FEATURES, LABEL, classes, uses, gamma, params.get("fourier", 200), seed=SEED,
                           task_bytes=params.get("task_bytes"), rows=ROWS, **limits)
    return [Member(m, classes) for m in found]


TREES = ("Random Forest", "Gradient Boosting", "XGBoost", "LightGBM")
LINEAR = ("Ridge Regression", "Lasso Regression")
FITTERS: dict[str, Callable[..., Member]] = {"Logistic Regression": _fit_logistic}


def known_name(name: str, task: str) -> str:
    """Names that a task does not have mean a random forest."""
    return name if name in (CLASSIFIERS if task == "classification" else REGRESSORS) else "Random Forest"


def _fit_members(
    df: DataFrame, name: str, classes: int, features: FeatureModel, uses: Sequence[Column], numbers: DataFrame, params: dict[str, Any]
) -> list[list[Member]]:
    """The members of one model per row filter in `uses`; bins are cut in the rows of `numbers`."""
    if name == "Ensemble" or name in TREES:
        bins = trees.bins_of(numbers, [F.col(c) for c in features.scratch[: features.numeric]], len(features.names), rows=ROWS)
    if name == "Ensemble":
        parts = [
            _fit_trees(df, "Random Forest", classes, features, uses, bins, {"trees": 150, **params}),
            _fit_trees(df, "Gradient Boosting", classes, features, uses, bins, {"rounds": 100, "levels": 3, **params}),
            _fit_trees(df, "XGBoost", classes, features, uses, bins, {"rounds": 100, "rate": 0.3, "share": 1.0, **params}),
        ]
        return [list(members) for members in zip(*parts)]
    if name in TREES:
        return [[m] for m in _fit_trees(df, name, classes, features, uses, bins, params)]
    if name == "SVM":
        return [[m] for m in _fit_kernel(df, classes, uses, params)]
    if name in LINEAR:
        return [[m] for m in _fit_linear(df, name, uses, params)]
    out = []
    for use in uses:
        rows = df.where(use)
        if classes:
            weighted = with_class_weights(rows, LABEL, WEIGHT, ROWS)
            rows = weighted.withColumn(WEIGHT, F.col(WEIGHT) * F.col(ROWS))
        out.append([FITTERS[name](rows, classes, **params)])
    return out


# ---------------------------------------------------------------- fitted model


@dataclass
class FittedModel:
    """A fitted model that scores raw tables; encoders are part of it."""

    task: str
    name: str
    target: str
    features: FeatureModel
    members: list[Member]
    labels: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def _scored(self, df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
        """Append the probabilities or the number.  Trees and support vectors score each
        distinct row of the model's columns once, and the rows of the table look theirs up;
        so do the others where those rows are known."""
        name = "prediction" if self.task == "regression" else "probability"
        large = all(hasattr(m.model, "scores") for m in self.members)
        if distinct is None:
            if not self.columns or not large:
                return self._scored_rows(df)
            distinct = df.select(*[quoted(c) for c in self.columns]).distinct()
        dealt = over_tasks(distinct) if large else by_rows(distinct, distinct.count())
        found = self._scored_rows(dealt).withColumnRenamed(name, "_found")
        return lookup_join(df, found, self.columns).select(*[quoted(c) for c in df.columns], F.col("_found").alias(name))

    def _scored_rows(self, df: DataFrame) -> DataFrame:
        out = self.features.transform(df.withColumn("_row", F.struct(*[quoted(c) for c in df.columns])))
        out = out.select("_row", FEATURES)
        for i, m in enumerate(self.members):
            kept = out.columns
            scored = m.score(out.withColumn("_keep", F.col(FEATURES)), f"_s{i}")
            out = scored.select(
                *[F.col("_keep").alias(c) if c == FEATURES else F.col(c) for c in kept], f"_s{i}"
            )
        scores = [F.col(f"_s{i}") for i in range(len(self.members))]
        if self.task == "regression":
            mean = sum(scores[1:], scores[0]) / len(scores)
            return out.select("_row.*", mean.alias("prediction"))
        mean = scores[0]
        for s in scores[1:]:
            mean = F.zip_with(mean, s, lambda a, b: a + b)
        return out.select(
            "_row.*", F.transform(mean, lambda p: p / len(scores)).alias("probability")
        )

    def predict(self, df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
        """Append ``prediction``: the class by its name, or the number.  ``distinct``: the
        distinct rows of the model's columns, where they are known."""
        return self._named(self._scored(df, distinct))

    def predict_each(self, df: DataFrame) -> DataFrame:
        """As :meth:`predict`, for a table whose rows hardly repeat."""
        return self._named(self._scored_rows(df))

    def _named(self, scored: DataFrame) -> DataFrame:
        if self.task == "regression":
            return scored
        return scored.withColumn("prediction", self._best()).drop("probability")

    def predict_proba(self, df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
        """Append ``prediction`` and one ``prob_class_i`` per class."""
        if self.task != "classification":
            raise ValueError("probabilities exist for classification only")
        scored = self._scored(df, distinct)
        return scored.select(
            *[quoted(c) for c in df.columns],
            self._best().alias("prediction"),
            *[F.get("probability", F.lit(i)).alias(f"prob_class_{i}") for i in range(len(self.labels))],
        )

    def _best(self) -> Column:
        place = F.array_position("probability", F.array_max("probability")).cast("int") - 1
        return F.get(F.array(*[F.lit(v) for v in self.labels]), place)

    def importance(self, df: DataFrame) -> DataFrame:
        """(feature, importance), largest first: the mean over members that have
        one, zeros if none has."""
        found = [m.weights for m in self.members if m.weights is not None]
        mean = np.mean(found, axis=0) if found else np.zeros(len(self.features.names))
        rows = [(n, float(v)) for n, v in zip(self.features.names, mean)]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
            F.col("importance").desc(), "feature"
        )


def over_tasks(df: DataFrame) -> DataFrame:
    """Deals few rows, whose work is large, to all cores; many to the usual number of tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """Deals rows whose work is small, and which a job per step may read, to tasks of ROWS_PER_TASK; to no more than :func:`over_tasks`."""
    spark = df.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(most, -(-rows // ROWS_PER_TASK))))


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct rows of some columns, and in ROWS how many rows each stands for; counts that the table has are added up."""
    n = F.sum(ROWS) if ROWS in df.columns else F.count("*")
    return df.groupBy(*[quoted(c) for c in columns]).agg(n.alias(ROWS))


def counted_by_part(placed: DataFrame, columns: Sequence[str], folds: int) -> DataFrame:
    """The distinct rows of some columns with their ``is_test`` and ``fold``, and in ROWS how many rows each stands for.

    A row of the columns is held once with a count per part, so that a task has fewer groups to hold and to move.
    """
    counts = [F.count_if((F.col("is_test") if held_out else ~F.col("is_test")) & (F.col("fold") == i)) for held_out in (False, True) for i in range(folds)]
    wide = placed.groupBy(*[quoted(c) for c in columns]).agg(F.array(*counts).alias("_parts"))
    kept = [quoted(c) for c in columns]
    return wide.select(*kept, F.posexplode("_parts").alias("_part", ROWS)).where(F.col(ROWS) > 0).select(
        *kept, (F.col("_part") >= folds).alias("is_test"), (F.col("_part") % folds).alias("fold"), ROWS)


def labelled(df: DataFrame, target: str, task: str) -> DataFrame:
    """For classes, missing is the class "nan"; rows without a number are dropped."""
    if task == "classification":
        text = F.when(is_missing(df, target), F.lit("nan")).otherwise(quoted(target).cast("string"))
        return df.withColumn(target, text)
    return df.where(~is_missing(df, target)).withColumn(target, quoted(target).cast("double"))


def fit(
    df: DataFrame, target: str, model: str = "Random Forest", task: str = "classification",
    columns: Sequence[str] | None = None, fit_on: DataFrame | None = None, **params: Any,
) -> FittedModel:
    """Fit one model.  Encoders and scalers see ``df`` unless ``fit_on`` is given."""
    return fit_each(df, [F.lit(True)], target, model, task, columns, fit_on, **params)[0]


def fit_apart(df: DataFrame, uses: Sequence[Column], *settings: Any, **params: Any) -> list[FittedModel]:
    """One model per row filter in ``uses``, each with its own encoders; their many short jobs run at the same time."""
    carried = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(min(len(uses), SIDE_BY_SIDE)) as pool:
        found = [pool.submit(carried(fit), df.where(u), *settings, **params) for u in uses]
    return [f.result() for f in found]


def fit_each(
    df: DataFrame, uses: Sequence[Column], target: str, model: str, task: str,
    columns: Sequence[str] | None = None, fit_on: DataFrame | None = None, **params: Any,
) -> list[FittedModel]:
    """One model per row filter in ``uses``, which share the encoders of the first one's rows.

    One pass over the rows keeps the distinct ones and how many rows each stands for;
    encoders, cuts and models follow from these.  A table that has ROWS is such a one.
    """
    name = known_name(model, task)
    columns = column_list(df, target, [ROWS]) if columns is None else list(columns)
    feature_columns(df, columns)
    flags = [f"_use{m}" for m in range(len(uses))]
    kept = [*dict.fromkeys([*columns, target]), *flags]
    marked = df.select("*", *[u.alias(f) for u, f in zip(uses, flags)])
    rows = marked if ROWS in df.columns else materialise(distinct_rows(marked, kept), "fit-rows")
    if fit_on is None:
        seen = rows.where(flags[0])
    else:
        seen = fit_on if ROWS in fit_on.columns else materialise(fit_on.groupBy(*[quoted(c) for c in columns]).agg(F.count("*").alias(ROWS)), "seen-rows")
    features = fit_features(seen, columns, ROWS)
    known = labelled(rows, target, task)
    if ROWS in df.columns:  # without what told them apart
        known = known.groupBy(*[quoted(c) for c in kept]).agg(F.sum(ROWS).alias(ROWS))
    dealt = by_rows(known, rows.count()) if name in LINEAR or name in FITTERS else over_tasks(known)
    ready = features.transform(dealt).select(FEATURES, quoted(target), ROWS, *flags)
    labels: list[str] = []
    if task == "classification":
        indexer = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc")
        index = indexer.fit(known.where(" or ".join(flags)))
        index.setHandleInvalid("skip")
        labels = list(index.labels)
        ready = index.transform(ready)
    else:
        ready = ready.withColumn(LABEL, quoted(target).cast("double"))
    ready = ready.drop(target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        members = _fit_members(ready, name, len(labels), features, [F.col(f) for f in flags], features.numbers(known.where(flags[0])), params)
    finally:
        ready.unpersist()
    return [FittedModel(task, model, target, features, m, labels, columns) for m in members]


# ---------------------------------------------------------------- training run


@dataclass
class TrainingRun:
    model: FittedModel
    predictions: DataFrame
    metrics: DataFrame
    folds: DataFrame | None

    def confusion(self) -> DataFrame:
        return evaluate.confusion_matrix(self.predictions, self.model.target, "prediction")

    def report(self) -> DataFrame:
        return evaluate.classification_report(self.predictions, self.model.target, "prediction")


def train(
    df: DataFrame, target: str, id_column: str, model: str = "Random Forest", task: str | None = None,
    test_size: float = 0.2, folds: int = 5, fit_on: str = "train", **params: Any,
) -> TrainingRun:
    """Split, fit, score the held-out rows and cross-validate.

    ``folds=0`` skips cross-validation.  ``fit_on="all"`` lets encoders and
    scalers see the held-out rows too.
    """
    require_columns(df, [target, id_column])
    if task is None:
        task = detect_task_type(df, [target]).first()["task"]
    columns = column_list(df, target, [id_column])
    by = target if task == "classification" else None
    # one ordering pass; every fit and fold below starts from the distinct rows of the written table
    placed = split_and_folds(labelled(df, target, task), id_column, by, test_size, folds or 2, SEED)
    kinds = list(dict.fromkeys([*columns, target]))
    parts = counted_by_part(placed, kinds, folds or 2) if folds <= FOLDS_SIDE_BY_SIDE else placed
    counted = materialise(distinct_rows(parts, [*kinds, "is_test", "fold"]), "distinct")
    everything = counted if fit_on == "all" else None
    uses = [~F.col("is_test"), *[F.col("fold") != i for i in range(folds)]]
    fits = fit_apart if known_name(model, task) in FITTERS else fit_each
    fitted, *in_folds = fits(counted, uses, target, model, task, columns, everything, **params)
    held_out = placed.where("is_test").drop("is_test", "fold")
    held_rows = counted.where("is_test").select(*[quoted(c) for c in columns]).distinct()
    # scored once; metrics, confusion and report read the written rows
    scored = materialise(
        fitted.predict_proba(held_out, held_rows) if task == "classification" else fitted.predict(held_out, held_rows),
        "scored",
    )
    scores = None
    if folds:
        scores = cross_validate(counted, target, model, task, columns, folds, everything, in_folds, **params)
    return TrainingRun(fitted, scored, _metrics(fitted, scored, scores), scores)


def cross_validate(
    dealt: DataFrame, target: str, model: str, task: str, columns: Sequence[str], folds: int,
    fit_on: DataFrame | None = None, fitted: Sequence[FittedModel] | None = None, **params: Any,
) -> DataFrame:
    """(fold, score) over a table with a ``fold`` column, by the models in ``fitted`` where they are given.
    The table may be one of distinct rows with ROWS.

    Trees and linear models of all folds are fitted together on one encoding, which
    only places rows on axes: linear models scale their columns by their own rows.
    For the others encoders and scalers are fitted inside each fold, the folds side by side.
    Folds are scored by their distinct rows, and the scores are stored.
    """
    known = known_name(model, task)
    held = materialise(distinct_rows(dealt, list(dict.fromkeys([*columns, target, "fold"]))), "fold-rows")
    uses = [F.col("fold") != i for i in range(folds)]
    if fitted is None and known not in FITTERS:
        fitted = fit_each(held, uses, target, model, task, columns, held if fit_on is None else fit_on, **params)
    elif fitted is None:
        fitted = fit_apart(held, uses, target, model, task, columns, fit_on, **params)
    rows = held.count()
    out = None
    for i, one in enumerate(fitted):
        own = held.where(F.col("fold") == i)
        scored = one.predict_each(by_rows(own, rows) if known in LINEAR or known in FITTERS else over_tasks(own))
        part = evaluate.weighted_fold_sums(scored, task, target, "prediction", ROWS)
        out = part if out is None else out.unionByName(part)
    if task == "classification":
        return materialise(out.select("fold", F.col("mean").alias("score")), "fold-scores")
    spreads = evaluate.weighted_spreads(held, target, ROWS)
    return materialise(out.join(spreads, "fold").select("fold", (1 - F.try_divide("mean", "spread")).alias("score")), "fold-scores")


def _metrics(model: FittedModel, scored: DataFrame, folds: DataFrame | None) -> DataFrame:
    """Long (position, metric, value), numbers to 4 digits."""
    target = model.target
    if model.task == "classification":
        one_row = evaluate.accuracy_f1(scored, target, "prediction")
        names = ["accuracy", "f1_score"]
        cv_name = "cv_mean_accuracy"
    else:
        one_row = evaluate.regression_metrics(scored, target, "prediction")
        names = ["mse", "rmse", "mae", "r2_score"]
        cv_name = "cv_mean_r2"
    parts = [(one_row, names)]
    if model.task == "classification" and len(model.labels) == 2:
        parts.append((evaluate.roc_auc(scored, target, "prob_class_1", model.labels[1]), ["roc_auc"]))
    if folds is not None:
        summary = evaluate.cv_summary(folds).withColumnRenamed("cv_mean", cv_name)
        parts.append((summary, [cv_name, "cv_std"]))
    out, position = None, 0
    for part, columns in parts:
        cells = []
        for c in columns:
            position += 1
            cells.append(F.struct(F.lit(position).alias("position"), F.lit(c).alias("metric"),
                                  F.round(F.col(c), 4).alias("value")))
        rows = part.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
