import pytest
from pyspark.sql import functions as F

from gridlens.operators import prep, split


def test_one_hot_drops_the_first_and_keeps_missing_as_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    out = prep.one_hot(df)
    assert out.columns == ["c_b"] and [r[0] for r in out.collect()] == [1, 0, 0, 1]


def test_one_hot_of_one_category_vanishes(spark):
    df = spark.createDataFrame([("z", 1)] * 4, "c string, x int")
    assert prep.one_hot(df).columns == ["x"]


def test_too_many_categories_raise(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prep.one_hot(df, limit=10)


@pytest.mark.parametrize(
    "text, numeric",
    [(" 12 ", True), ("1e3", True), ("+5", True), ("inf", True), ("", True), ("1d", False),
     ("1_000", False), ("0x1A", False), ("True", False), ("nan", False)],
)
def test_what_counts_as_a_number(spark, text, numeric):
    df = spark.createDataFrame([("7",), (text,)], "s string")
    assert prep.numeric_text_columns(df).first()["is_numeric"] is numeric


def test_empty_text_becomes_missing_number(spark):
    out = prep.coerce_numeric(spark.createDataFrame([("1",), ("",)], "s string"))
    assert [r[0] for r in out.collect()] == [1.0, None]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert [r[0] for r in prep.fill_missing(df).collect()][-1] == "a"


def test_fill_by_type(spark):
    df = spark.createDataFrame([(1, True, "x"), (None, None, None), (4, False, "x")], "n int, b boolean, s string")
    assert tuple(prep.fill_missing(df, "median").collect()[1]) == (2.5, False, "x")
    assert tuple(prep.fill_missing(df, "zero").collect()[1]) == (0, False, "x")
    with pytest.raises(ValueError):
        prep.fill_values(df, "best")


def test_column_without_any_text_is_unknown(spark):
    df = spark.createDataFrame([(None, 1)], "s string, x int")
    assert prep.fill_missing(df).first()["s"] == "unknown"
    assert prep.preprocess(df).columns == ["x"]


def test_scaling_a_constant_gives_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, None), (3.0, 3.0)], "k double, x double")
    rows = prep.impute_and_scale(df).collect()
    assert [r["k"] for r in rows] == [0.0, 0.0, 0.0]
    assert [round(r["x"], 4) for r in rows] == [-1.2247, 0.0, 1.2247]


def test_scaling_drops_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, e double")
    assert prep.impute_and_scale(df).columns == ["x"]


def test_codes_put_missing_under_nan(spark):
    df = spark.createDataFrame([("z",), (None,), ("a",)], "s string")
    assert [r["code"] for r in prep.label_encode(df, "s").orderBy("code").collect()] == [0, 1, 2]
    codes = {r["value"]: r["code"] for r in prep.label_codes(df, "s").collect()}
    assert codes == {"a": 0, "nan": 1, "z": 2}


def test_target_must_exist(spark):
    with pytest.raises(ValueError):
        prep.split_features_target(spark.range(1), "y")


def test_single_row_class_falls_back_to_random_split(spark):
    df = spark.range(20).withColumn("y", (F.col("id") == 0).cast("int"))
    assert not split.can_stratify(df, "y")
    out = split.train_test_split(df, "id", "y", 0.25)
    assert out.where("is_test").count() == 5


def test_split_and_folds_agree_with_their_parts(spark):
    df = spark.range(200).withColumn("y", F.col("id") % 3)
    both = split.split_and_folds(df, "id", "y", 0.2, 4)
    one = split.train_test_split(df, "id", "y", 0.2)
    assert sorted(both.drop("fold").collect()) == sorted(one.collect())
    sizes = [r["count"] for r in both.groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_nested_columns_take_their_most_frequent_value(spark):
    df = spark.sql("select * from values (1, array(1, 2), map('a', 1)), (2, array(1, 2), null), (3, null, map('a', 1)), (4, array(3), map('b', 2)) as t(id, a, m)")
    empty = df.select("id", F.lit(None).cast("array<int>").alias("a"))
    rows = {r["id"]: r for r in prep.fill_missing(df).collect()}
    assert rows[3]["a"] == [1, 2] and rows[2]["m"] == {"a": 1} and rows[4]["a"] == [3]
    assert {r["a"] for r in prep.fill_missing(empty).collect()} == {None}


@pytest.mark.parametrize("by", [None, "y"])
def test_held_out_rows_are_read_from_their_buckets_alone(spark, by):
    rows = [(None if i % 50 == 0 else f"k{i // 2}", "a" if i % 3 else "b", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, y string, v long")
    placed = split.split_and_folds(df, "id", by, 0.2, 4)
    held_out = placed.where("is_test")
    plan = held_out._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(_bucket" in plan
    want = {"a": 400, "b": 200} if by else None
    got = {r["y"]: r["count"] for r in held_out.groupBy("y").count().collect()}
    assert got == want if by else sum(got.values()) == 600
    assert placed.where("is_test is null").count() == 0 and placed.count() == 3000
    assert sorted(r["count"] for r in placed.groupBy("fold").count().collect()) == [750] * 4
