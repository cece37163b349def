import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridlens.operators import evaluate, kernel, labels, linear, models, trees
from gridlens.operators.features import fit_features
from gridlens.sources.tables import read_table

SMALL = dict(trees=5, depth=4, rounds=5, iterations=30, fourier=32)


@pytest.fixture(scope="module")
def items(spark, folder):
    df = read_table(spark, folder, "lineitem")
    net = F.col("l_quantity") * (1 - F.col("l_discount"))
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_extendedprice").alias("id"), "l_quantity",
        "l_discount", "l_returnflag", net.alias("y"), F.when(net > 25, "big").otherwise("small").alias("size"),
    ).cache()


def test_features_match_the_hand_computed_matrix(spark):
    df = spark.createDataFrame([(1.0, "b", True), (None, "a", False), (4.0, "c", True), (7.0, "b", None)],
                               "x double, s string, f boolean")
    fitted = fit_features(df)
    assert fitted.names == ["x", "f", "s_c", "s_b"]
    got = np.array([r["features"].toArray() for r in fitted.transform(df).collect()])
    x = np.array([1.0, 4.0, 4.0, 7.0])
    np.testing.assert_allclose(got[:, 0], (x - x.mean()) / x.std())
    b = np.array([1.0, 0, 0, 1.0])
    np.testing.assert_allclose(got[:, 3], b / b.std())
    unseen = spark.createDataFrame([(1.0, "zzz", True), (1.0, None, True)], df.schema)
    assert all(r["features"].toArray()[2:].sum() == 0 for r in fitted.transform(unseen).collect())


def test_empty_column_leaves_features_and_names(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, e double")
    assert fit_features(df).names == ["x"]


def test_ridge_equals_the_normal_equations(items):
    data = items.select("l_quantity", "l_discount", "y")
    model = models.fit(data, "y", "Ridge Regression", "regression", alpha=10.0).members[0].model
    rows = np.array(data.collect(), dtype=float)
    x = (rows[:, :2] - rows[:, :2].mean(0)) / rows[:, :2].std(0)
    want = np.linalg.solve(x.T @ x + 10.0 * np.eye(2), x.T @ (rows[:, 2] - rows[:, 2].mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-8)


def test_classifier_beats_the_majority(items):
    data = items.drop("y")
    run = models.train(data, "size", "id", "Random Forest", folds=0, **SMALL)
    metrics = {r["metric"]: r["value"] for r in run.metrics.collect()}
    majority = max(r["count"] for r in data.groupBy("size").count().collect()) / data.count()
    assert metrics["accuracy"] > majority + 0.2 and metrics["roc_auc"] > 0.9
    first = run.predictions.first()
    assert abs(first["prob_class_0"] + first["prob_class_1"] - 1) < 1e-9
    assert {r["actual"] for r in run.confusion().collect()} == {"big", "small"}
    total = run.model.importance(data).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)
    again = models.train(data, "size", "id", "Random Forest", folds=0, **SMALL)
    assert {r["metric"]: r["value"] for r in again.metrics.collect()} == metrics


def test_cross_validation_scores_every_fold(items):
    run = models.train(items.drop("size"), "y", "id", "Ridge Regression", folds=3)
    assert sorted(r["fold"] for r in run.folds.collect()) == [0, 1, 2]
    metrics = {r["metric"]: r["value"] for r in run.metrics.collect()}
    assert set(metrics) == {"mse", "rmse", "mae", "r2_score", "cv_mean_r2", "cv_std"}
    assert metrics["cv_mean_r2"] > 0.9


def test_ensemble_is_the_mean_of_its_members(items):
    data = items.select("l_quantity", "l_discount", "y")
    fitted = models.fit(data, "y", "Ensemble", "regression", **SMALL)
    assert len(fitted.members) == 3
    alone = [models.FittedModel("regression", "one", "y", fitted.features, [m]) for m in fitted.members]
    want = np.mean([[r["prediction"] for r in m.predict(data).collect()] for m in alone], axis=0)
    got = [r["prediction"] for r in fitted.predict(data).collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_kernel_model_separates_a_ring(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(600, 2))
    rows = [(float(a), float(b), int(a * a + b * b > 1.4)) for a, b in points]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    kernel = models.fit(df, "y", "SVM", **SMALL).predict(df)
    linear = models.fit(df, "y", "Logistic Regression", **SMALL).predict(df)
    right = [d.where("cast(y as string) = prediction").count() / 600 for d in (kernel, linear)]
    assert right[0] > 0.9 > right[1]


def test_unknown_name_means_random_forest(items):
    fitted = models.fit(items.select("l_quantity", "y"), "y", "Best Model", "regression", **SMALL)
    assert "RandomForest" in type(fitted.members[0].model).__name__


def test_missing_class_is_a_class_of_its_own(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else None) for i in range(40)], "x double, y string")
    fitted = models.fit(df, "y", "Random Forest", **SMALL)
    assert fitted.labels == ["a", "nan"]


def test_no_probabilities_for_numbers(items):
    fitted = models.fit(items.select("l_quantity", "y"), "y", "Lasso Regression", "regression")
    with pytest.raises(ValueError):
        fitted.predict_proba(items)


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 40, 400)
    truth = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, scores)], "y int, s double")
    pos, neg = scores[truth == 1], scores[truth == 0]
    want = np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    assert evaluate.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] is None


def test_top_labels(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0, 1.0])], "id int, s array<double>")
    rows = labels.top_labels(df, "s", ["red_fox", "big_cat", "dog"], 2).collect()
    assert [(r["rank"], r["label"]) for r in rows] == [(1, "Big Cat"), (2, "Dog")]
    p = np.exp([0, 3, 1]) / np.exp([0, 3, 1]).sum()
    assert rows[0]["score"] == round(p[1], 4) and rows[0]["confidence"] == f"{p[1] * 100:.2f}%"


@pytest.mark.parametrize("cells", [1, 6, 10**6])
def test_nearest_labels_by_blocks(spark, cells):
    """Blocks of one class, of two and of all give the same ranks and shares."""
    rng = np.random.default_rng(3)
    vectors, means = rng.normal(size=(40, 3)), rng.normal(size=(7, 3))
    means[5] = means[2]  # a tie goes to the smaller label
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, v array<double>")
    c = spark.createDataFrame([(f"big_{k}", m.tolist()) for k, m in enumerate(means)], "label string, centroid array<double>")
    got = {(r["id"], r["rank"]): (r["label"], r["score"]) for r in labels.nearest_labels(df, "v", c, 3, cells).collect()}
    p = np.exp(vectors @ means.T)
    p /= p.sum(axis=1, keepdims=True)
    for i in range(40):
        for rank, k in enumerate(np.argsort(-p[i], kind="stable")[:3], start=1):
            assert got[i, rank] == (f"Big {k}", pytest.approx(p[i, k], abs=6e-5))


def test_infinite_values_count_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    got = np.array([r["features"][0] for r in fit_features(df).transform(df).collect()])
    filled = np.array([1, 2, 4, 2, 2, 2], dtype=float)
    np.testing.assert_allclose(got, (filled - filled.mean()) / filled.std(), rtol=1e-12)


def _repeated(spark):
    """Six distinct rows, each of them many times."""
    return spark.range(600).select(
        F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 3).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "a").alias("g"), ((F.col("id") % 3) * 2 + F.col("id") % 2).cast("double").alias("y"))


@pytest.mark.parametrize("name", ["XGBoost", "SVM", "Ridge Regression"])
def test_folds_and_fits_see_distinct_rows(spark, name, monkeypatch):
    seen = []
    counted = models.distinct_rows
    monkeypatch.setattr(models, "distinct_rows", lambda df, columns: seen.append(counted(df, columns)) or seen[-1])
    run = models.train(_repeated(spark), "y", "id", name, "regression", folds=3, **{**SMALL, "rounds": 60})
    assert [d.agg(F.sum(models.ROWS)).first()[0] for d in seen] == [600, 600]
    assert seen[1].count() <= 6 * 3
    # the stored scores are not computed anew by each reader
    assert "Python" not in run.folds._jdf.queryExecution().executedPlan().toString()
    assert run.folds.where("score > 0.5").count() == 3
    plain = evaluate.fold_scores(run.model.predict(run.predictions.withColumn("fold", F.lit(0)).drop("prediction")), "regression", "y", "prediction")
    assert plain.first()["score"] > 0.5


def test_weights_count_as_rows(spark):
    df = _repeated(spark).select("x", "y", (F.col("id") != "r1").alias("u"))
    parts = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    few = VectorAssembler(inputCols=["x"], outputCol="features").transform(models.distinct_rows(df, ["x", "y", "u"]))
    uses = [F.lit(True), F.col("u")]
    for one, two in zip(linear.moments(parts, "features", "y", uses), linear.moments(few, "features", "y", uses, models.ROWS)):
        assert np.allclose(one, two)
    sets = [sorted((list(r["x"]), r["y"], list(r["rows"])) for r in c.collect()) for c in (
        kernel.cells_of(parts, "features", "y", uses), kernel.cells_of(few, "features", "y", uses, models.ROWS))]
    assert sets[0] == sets[1]
    bins = trees.fit_bins(parts, "features", 1, 1)
    sets = [sorted((bytes(r["x"]), list(r["rows"]), list(r["sums"])) for r in c.collect()) for c in (
        trees.cells_of(parts, "features", "y", 0, uses, bins), trees.cells_of(few, "features", "y", 0, uses, bins, models.ROWS))]
    assert sets[0] == sets[1]


def test_scores_are_looked_up_by_missing_values_too(spark):
    df = spark.createDataFrame([(i, [None, float("nan"), 0.0, -0.0, 2.0][i % 5], [None, "p", "q"][i % 3], float(i % 5 > 1)) for i in range(60)],
                               "k int, x double, g string, y double")
    fitted = models.fit(df, "y", "XGBoost", "regression", ["x", "g"], rounds=5)
    found = fitted.predict(df)
    assert found.columns == ["k", "x", "g", "y", "prediction"]
    each = {r["k"]: r["prediction"] for r in fitted.predict_each(df).collect()}
    assert len(each) == 60 and {r["k"]: r["prediction"] for r in found.collect()} == each


@pytest.mark.parametrize("name", ["Random Forest", "Logistic Regression", "Ridge Regression"])
def test_encoders_and_models_start_from_distinct_rows(spark, name, monkeypatch):
    seen, fitted = [], models.fit_features
    monkeypatch.setattr(models, "fit_features", lambda df, *rest: seen.append(df.count()) or fitted(df, *rest))
    df = _repeated(spark)
    task = "classification" if name == "Logistic Regression" else "regression"
    settings = {**SMALL, "iterations": 5} if name != "Logistic Regression" else {"iterations": 5}
    run = models.train(df.withColumn("y", F.col("y").cast("string")) if task == "classification" else df, "y", "id", name, task, folds=2, **settings)
    assert seen and max(seen) <= 6 * 2 * 2
    assert run.predictions.count() == 120 and run.predictions.columns[:4] == ["id", "x", "g", "y"]
    assert run.folds.count() == 2


def test_logistic_fits_run_side_by_side_on_few_tasks(spark, monkeypatch):
    """A job per step reads as many tasks as the rows are worth; no fit waits for another."""
    met, tasks, plain = threading.Barrier(4, timeout=120), [], models.FITTERS["Logistic Regression"]

    def fitted(rows, classes, **params):
        met.wait()
        tasks.append(rows.rdd.getNumPartitions())
        return plain(rows, classes, **params)

    monkeypatch.setitem(models.FITTERS, "Logistic Regression", fitted)
    df = _repeated(spark).withColumn("y", F.when(F.col("x") > 0, "p").otherwise("q"))
    run = models.train(df, "y", "id", "Logistic Regression", "classification", folds=3)
    assert tasks == [1] * 4
    assert sorted(r["fold"] for r in run.folds.where("score > 0.5").collect()) == [0, 1, 2]


@pytest.mark.parametrize("folds", [3, 0])
def test_parts_are_counted_per_distinct_row(spark, folds, monkeypatch):
    """A task groups rows by their values alone; the counts per fold and split are the same."""
    placed = _repeated(spark).withColumn("is_test", F.col("id") < "r2").withColumn("fold", F.crc32("id") % (folds or 2))
    columns = ["x", "g", "y"]
    plain = placed.groupBy(*columns, "is_test", "fold").count()
    counted = models.counted_by_part(placed, columns, folds or 2)
    assert counted.columns == [*columns, "is_test", "fold", models.ROWS]
    assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    seen, counts = [], models.distinct_rows
    monkeypatch.setattr(models, "distinct_rows", lambda df, columns: seen.append(df) or counts(df, columns))
    models.train(_repeated(spark), "y", "id", "Ridge Regression", "regression", folds=folds)
    assert seen[0].count() <= 6 * 2 * (folds or 2)


def test_counted_rows_give_the_same_features(spark):
    rows = [(0.1, None, "a", None), (None, 2.0, "b", None), (0.1, float("nan"), "b", None), (0.1, 7.0, None, None), (None, 3.0, "c", None)]
    few = spark.createDataFrame([(*r, k * k + 1) for k, r in enumerate(rows)], "c double, x double, g string, e double, n long")
    every = few.select("c", "x", "g", "e", F.explode(F.expr("sequence(1, n)"))).drop("col")
    one, two = fit_features(every), fit_features(few, ["c", "x", "g", "e"], "n")
    assert one.names == two.names and one.numeric == two.numeric
    parts = [np.array([r["features"].toArray() for r in m.transform(few).orderBy("n").collect()]) for m in (one, two)]
    np.testing.assert_allclose(*parts, rtol=1e-12)
    assert (parts[1][:, 0] == 0).all()  # equal values have no deviation, however often they are added up


def test_spreads_of_counted_rows(spark):
    rows = [(0, 0.1, 3), (0, 0.1, 7), (1, 1.0, 2), (1, 4.0, 1), (1, None, 5), (2, None, 1)]
    few = spark.createDataFrame(rows, "fold int, y double, n long")
    got = {r["fold"]: r["spread"] for r in evaluate.weighted_spreads(few, "y", "n").collect()}
    assert got == {0: 0.0, 1: pytest.approx(np.var([1.0, 1.0, 4.0])), 2: None}


def test_known_distinct_rows_give_the_same_predictions(items):
    data = items.select("l_quantity", "l_discount", "l_returnflag", "y")
    fitted = models.fit(data, "y", "Ridge Regression", "regression")
    kinds = data.drop("y").distinct()
    one, two = (sorted(map(tuple, d.collect())) for d in (fitted.predict(data), fitted.predict(data, kinds)))
    assert one == two
