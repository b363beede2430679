"""Small rules: column order, labels, records, sources, classes in range."""

import functools
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import encode, grid, runlog, scenario, score, split, validate
from sparkforest.sources import io


def test_features_in_a_models_order(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 7)], "a int, b double, c string, id int")
    assert scenario.project_features(df, ["b", "a"], ["id"]).first().asDict() == {"id": 7, "b": 2.0, "a": 1}
    with pytest.raises(ValueError, match="missing features"):
        scenario.project_features(df, ["b", "z"])


def test_predicted_labels_are_known(spark):
    df = spark.createDataFrame([("a",), ("b",), ("q",), ("q",)], "prediction string")
    assert [r["prediction"] for r in validate.check_predictions(df, ["a", "b"]).collect()] == ["q", "q"]
    assert encode.fallback_labels(spark.range(4), "id") == ["0", "1", "2", "3"]


def test_first_of_the_grid(spark):
    plan = grid.plan_grid(spark, "j", {"max_depth": [3, 5], "criterion": ["gini", "entropy"]}, "classification")
    assert grid.select_initial(plan).first()["experiment_id"] == "j_exp_000" and plan.count() == 4


def test_targets_have_to_fit_the_task(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    with pytest.raises(ValueError, match="numeric"):
        validate.validate(df, "y", "regression")


def test_classes_out_of_range_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0), (1, 2), (1, 2)], "row_id int, label_idx int")
    assert sorted(map(tuple, score.long_votes(rows, n_classes=3).collect())) == [(1, 0, 1), (1, 2, 2)]
    for bad in (2, -1, None):
        odd = spark.createDataFrame([(1, bad)], "row_id int, label_idx int")
        with pytest.raises(Exception, match="no class"):
            score.long_votes(odd, n_classes=2).collect()


def test_records_take_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"job_id": "j1", "created_at": 1.5}))
    (tmp_path / "b.json").write_text(json.dumps({"job_id": "j2", "status": "RUNNING"}))
    (tmp_path / "c.json").write_text("{not json")
    rows = {r["job_id"]: (r["status"], r["created_at"]) for r in io.read_records(spark, str(tmp_path), "job").collect() if r["job_id"]}
    assert rows == {"j1": ("PENDING", 1.5), "j2": ("RUNNING", None)}


def test_parquet_and_http_sources(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    assert io.load(spark, f"{tmp_path}/t.parquet").count() == 5
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "d.csv").write_text("a,b\n1,x\nNA,y\n3,z\n")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "web"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = io.load(spark, f"http://127.0.0.1:{server.server_port}/d.csv")
        assert df.dtypes == [("a", "bigint"), ("b", "string")] and sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "a long, b string").collect()))
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="stage it"):
        io.load(spark, "http://127.0.0.1/d.parquet")


def test_shards_of_repeated_values(spark):
    df = spark.range(103).select((F.col("id") % 10).alias("k"))
    out = split.shard_rows(df, "k", 4)
    assert [r["count"] for r in out.groupBy("shard").count().orderBy("shard").collect()] == [25, 25, 25, 28]


def test_failed_ids_come_once(spark):
    log = spark.createDataFrame([("t1", 1, ["x", "y"]), ("t1", 2, ["y"]), ("t2", 3, []), ("t2", 4, None), ("t3", 5, ["z", "x"])], "task string, updated_at int, failed_tree_ids array<string>")
    out = runlog.distinct_items(log, "failed_tree_ids", "updated_at")
    assert sorted(r[0] for r in out.select(out.columns[0]).collect()) == ["x", "y", "z"]


def test_what_a_request_may_ask_for():
    from sparkforest.plans.training import TrainingRequest

    ok = dict(target="y", task_type="classification", row_id="id")
    validate.validate_request(TrainingRequest(**ok, backend="sql", missing="tree", draws="exact", categories="codes", bins=None))
    for bad in (dict(missing="tree"), dict(missing="zero"), dict(draws="exact"), dict(draws="x", backend="sql"), dict(categories="all"), dict(backend="rdd")):
        with pytest.raises(ValueError):
            validate.validate_request(TrainingRequest(**ok, **bad))
