"""Forests scored by joins, requests by the model they name, and streams of them."""

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import metrics, score, train
from sparkforest.operators.grid import ForestConfig
from sparkforest.plans.models import score_requests
from sparkforest.plans.training import TrainingRequest
from sparkforest.plans.training import train as train_job
from sparkforest.sources import io
from sparkforest.streaming import streams

REQUEST = "request_id long, model_id string, values array<double>, n_rows int, n_cols int"


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 > 0, (F.col("id") * 37 % 101).cast("double")).alias("a"), (F.col("id") * 53 % 29).cast("double").alias("b"))
    df = df.unionByName(df.where("row_id < 20"))
    return train.stored(df.withColumn("y", F.when((F.col("a") > 50) & (F.col("b") < 15), "yes").otherwise("no")))


@pytest.mark.parametrize("most", [50_000, 3])
def test_joins_score_as_arrays(spark, rows, most, monkeypatch):
    monkeypatch.setattr(score, "LEVEL_NODES", most)
    nodes = train.fit_forest_sql(rows.withColumn("y", (F.col("y") == "yes").cast("int")), ["a", "b"], "y", ForestConfig(3, None), n_classes=2, bins=None)
    key = lambda df: sorted(str(tuple(r)) for r in df.select("row_id", "a", "b", "tree_predictions").collect())
    monkeypatch.setattr(score, "forest_arrays", None) if most == 3 else None
    joined = score.predict_trees_by_joins(rows.withColumn("_row", F.lit(1)), nodes, ["a", "b"])
    assert joined.columns == ["row_id", "a", "b", "y", "_row", "tree_predictions"] and joined.count() == 520
    monkeypatch.undo()
    assert key(joined) == key(score.predict_trees(rows, nodes, ["a", "b"]))


@pytest.fixture(scope="module")
def published(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    ask = lambda task, target: TrainingRequest(target, task, "row_id", 3, space={"max_depth": [3]}, backend="sql", missing="tree")
    one = train_job(spark, rows, ask("classification", "y"), root, job_id="classes")
    two = train_job(spark, rows.select("row_id", "b", (F.col("b") * 2).alias("v")), ask("regression", "v"), root, job_id="numbers")
    return root, one, two


def test_requests_go_to_the_model_they_name(spark, rows, published):
    root, one, two = published
    asked = [(1, "model_classes", [60.0, 3.0, None, 3.0, 1.0, 1.0], 3, 2), (1, "model_classes", [60.0, 3.0], 1, 2), (2, "model_numbers", [4.0, 28.0], 2, 1), (3, "model_other", [1.0], 1, 1), (4, "model_numbers", [1.0, 2.0], 1, 2), (5, "model_classes", [1.0], 1, 2), (6, "model_classes", [], 0, 2)]
    got = score_requests(spark.createDataFrame(asked, REQUEST), root).collect()
    good = sorted((r["request_id"], r["row_no"], r["label"], r["value"]) for r in got if r["error"] is None)
    label = lambda a, b: one.model.predict(spark.createDataFrame([(a, b)], "a double, b double")).first()["prediction"]
    value = lambda b: two.model.predict(spark.createDataFrame([(b,)], "b double")).first()["prediction"]
    first = (1, 0, label(60.0, 3.0), None)
    assert good[:4] == [first, first, (1, 1, label(None, 3.0), None), (1, 2, label(1.0, 1.0), None)]
    assert [x[:3] for x in good[4:]] == [(2, 0, None), (2, 1, None)] and [x[3] for x in good[4:]] == pytest.approx([value(4.0), value(28.0)])
    assert {r["request_id"]: r["error"] for r in got if r["error"]} == {3: "no such model", 4: "the model has other features", 5: "payload size is not n_rows * n_cols"}
    assert score_requests(spark.createDataFrame([], REQUEST), root).collect() == []


def test_a_model_published_in_mid_stream_scores_later_requests(spark, rows, published, tmp_path):
    root, one, _ = published
    seen: dict[int, list] = {}
    asked = lambda i: spark.createDataFrame([(i, "model_late", [60.0, 3.0], 1, 2), (i, "model_classes", [60.0, 3.0], 1, 2)], REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    asked(1)
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.published_stream(stream, root, lambda df, n: seen.__setitem__(n, df.collect())).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        train_job(spark, rows, TrainingRequest("y", "classification", "row_id", 2, space={"max_depth": [3]}, backend="sql", missing="tree"), root, job_id="late")
        asked(2)
        query.processAllAvailable()
    finally:
        query.stop()
    found = {(r["request_id"], r["model_id"]): (r["label"], r["error"]) for rows_of in seen.values() for r in rows_of}
    label = one.model.predict(spark.createDataFrame([(60.0, 3.0)], "a double, b double")).first()["prediction"]
    assert found == {(1, "model_late"): (None, "no such model"), (1, "model_classes"): (label, None), (2, "model_late"): (found[2, "model_late"][0], None), (2, "model_classes"): (label, None)}
    assert found[2, "model_late"][0] in ("yes", "no")


def test_importances_by_hand(spark):
    nodes = spark.createDataFrame([(0, 1, 0, 1.0, 2, 3, 0.0, 10.0, 0.3), (0, 2, 1, 1.0, 4, 5, 0.0, 5.0, 0.2), (1, 1, 1, 1.0, 2, 3, 0.0, 8.0, 0.5), (1, 2, -1, None, -1, -1, 0.0, 4.0, 0.0)], train.NODES)
    got = {r["feature"]: r["importance"] for r in metrics.feature_importances(nodes, ["a", "b", "c"]).collect()}
    assert got == pytest.approx({"a": 3 / 4 / 2, "b": (1 / 4 + 1) / 2, "c": 0.0})


def test_nodes_of_all_models(spark, published):
    root, _, _ = published
    assert {"model_classes", "model_numbers"} <= {r[0] for r in io.read_nodes(spark, root, None).select("model_id").distinct().collect()}
