"""String columns with many values: codes by the label, and models that have them."""

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import encode, train
from sparkforest.plans.models import load_model
from sparkforest.plans.training import TrainingRequest
from sparkforest.plans.training import train as train_job


def test_codes_follow_mean_and_value(spark):
    rows = [("a", "x", 1.0), ("a", "x", 0.0), ("b", None, 1.0), ("c", "y", 0.0), (None, "y", 1.0), (None, "x", 1.0)]
    df = spark.createDataFrame(rows, "s string, t string, y double")
    got = {(r["column"], r["value"]): (r["n"], r["mean"], r["code"]) for r in encode.category_codes(df, ["s", "t"], "y", 2).collect()}
    assert got == {("s", "c"): (1, 0.0, 0), ("s", "a"): (2, 0.5, 1), ("s", None): (2, 1.0, 2), ("s", "b"): (1, 1.0, 3), ("t", "y"): (2, 0.5, 0), ("t", "x"): (3, 2 / 3, 1), ("t", None): (1, 1.0, 2)}
    codes = encode.category_codes(df, ["s", "t"], "y", 2)
    asked = spark.createDataFrame([(1, "a", "zz"), (2, None, None), (3, "new", "x")], "id int, s string, t string")
    assert sorted(tuple(r) for r in encode.with_codes(asked, codes, ["s", "t"]).collect()) == [(1, 1.0, -1.0), (2, 2.0, 2.0), (3, -1.0, 1.0)]
    assert encode.category_codes(df.limit(0), ["s"], "y", 2).collect() == []


def test_columns_are_divided_by_their_values(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 90).cast("string").alias("some"))
    assert encode.divide_columns(df, ["many", "few", "some"], 150) == (["few", "some"], ["many"])
    assert encode.divide_columns(df, ["many", "few"], 2000) == (["many", "few"], []) and encode.divide_columns(df, []) == ([], [])


@pytest.mark.parametrize(("backend", "task"), [("sql", "classification"), ("ml", "regression")])
def test_model_of_many_categories(spark, tmp_path, backend, task):
    """40,000 values, each in three rows, whose last digit decides the label."""
    df = spark.range(120_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 40_000).alias("s"), (F.col("id") % 7).cast("double").alias("a"))
    share = (F.col("row_id") % 10 < 5).cast("int")
    df = train.stored(df.withColumn("y", F.when(share == 1, "yes").otherwise("no") if task == "classification" else 10.0 * share + F.col("a")))
    ask = TrainingRequest("y", task, "row_id", 2, space={"max_depth": [3], "max_features": ["none"]}, backend=backend, categories="codes")
    with pytest.raises(ValueError, match="categories are more"):
        train_job(spark, df, TrainingRequest("y", task, "row_id", 2))
    r = train_job(spark, df, ask, str(tmp_path))
    # One value of sixteen isn't in the training rows; its code comes before all, as the lowest label.
    assert (r.test["accuracy"] or 0) > 0.85 or (r.test["r2"] or 0) > 0.65
    assert r.model.coded == ["s"] and r.features == ["s", "a"]
    m = load_model(spark, str(tmp_path), r.model.model_id)
    few = df.where("row_id < 300").withColumn("s", F.when(F.col("row_id") % 2 == 0, F.col("s")).otherwise("unseen"))
    both = m.predict(few).select("row_id", "prediction").join(r.predict(few).select("row_id", F.col("prediction").alias("p")), "row_id")
    assert both.count() == 300 and both.where("prediction <> p").isEmpty()
