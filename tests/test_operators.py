import pytest
from pyspark.sql import functions as F

from sparkforest.operators import encode, grid, metrics, registry, runlog, scenario, score, split, train, validate
from sparkforest.plans.training import TrainingRequest
from sparkforest.plans.training import train as train_job
from sparkforest.sources import io


def test_resolve_source():
    assert io.resolve_source(" /a/b.csv ").format == "csv"
    assert io.resolve_source("file:///a%20b/c.pq") == io.Source("/a b/c.pq", "parquet", "file")
    assert io.resolve_source("file://host/c.csv").path == "//host/c.csv"
    assert io.resolve_source("https://x/y.csv?v=1").format == "csv"
    for bad in ("", "ftp://x/y.csv", "/a/b.txt", "http://x/y.parquet"):
        with pytest.raises(ValueError):
            io.resolve_source(bad)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,1.5,true,x\nNA,2,false,null\n3,n/a,,y\n")
    df = io.load(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    assert [r["d"] for r in df.collect()] == ["x", None, "y"]
    with pytest.raises(FileNotFoundError):
        io.load(spark, str(tmp_path / "absent.csv"))


def test_scenarios(spark):
    df = spark.createDataFrame([(1, 2.0, 0)], "hba1c int, bmi double, diagnosed_diabetes int")
    assert scenario.apply_scenario(df, "diagnosed_diabetes", " Clinical_Only ")[0].columns == ["bmi", "diagnosed_diabetes"]
    assert scenario.apply_scenario(df, "diagnosed_diabetes", "no_diagnostic_features")[0].columns == ["bmi", "diagnosed_diabetes"]
    with pytest.raises(ValueError):
        scenario.apply_scenario(df, "diagnosed_diabetes", "other")
    with pytest.raises(ValueError):
        scenario.apply_scenario(df, "diagnosed_diabetes", None, ["diagnosed_diabetes"])


def test_one_hot_order_and_nulls(spark):
    df = spark.createDataFrame([("b", 1, True, 0), (None, 2, False, 1), ("a", 3, True, 0)], "s string, n int, f boolean, y int")
    out = encode.one_hot(df, encode.fit_vocab(df, ["s"]), "y")
    assert out.columns == ["n", "f", "s_a", "s_b", "s_nan", "y"]
    assert [tuple(r)[2:5] for r in out.orderBy("n").collect()] == [(0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]
    clash = spark.createDataFrame([("A", 1), ("a", 2)], "s string, n int")
    with pytest.raises(ValueError):
        encode.fit_vocab(clash, ["s"])


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    args = dict(validation_ratio=0.2, test_ratio=0.3, seed=1, row_id="id", target="y", task_type="classification", exact=True)
    a = {r["id"]: r["split"] for r in split.assign_splits(df.repartition(1), **args).collect()}
    b = {r["id"]: r["split"] for r in split.assign_splits(df.repartition(7), **args).collect()}
    assert a == b and len(a) == 1000
    assert sum(v == "test" for v in a.values()) == 101 + 200  # ceil of each class
    none = split.assign_splits(df, validation_ratio=0, test_ratio=0, seed=1, row_id="id")
    assert none.where("split <> 'train'").isEmpty()


def test_grid(spark):
    space = {"max_depth": [3, 0], "max_features": ["sqrt", "log2"], "min_samples_split": [2, 4], "min_samples_leaf": [1, 2], "criterion": ["gini", "entropy"]}
    rows = grid.plan_grid(spark, "job", space, "classification").orderBy("ordinal").collect()
    assert len(rows) == 32 and [r["criterion"] for r in rows[:2]] == ["gini", "entropy"] and rows[31]["experiment_id"] == "job_exp_031"
    assert rows[16]["max_depth"] is None
    d = grid.plan_grid(spark, "job", {}, "regression").first()
    assert (d["max_features"], d["criterion"]) == ("1.0", "squared_error")
    assert [grid.resolve_max_features(v, 10) for v in (None, "none", "sqrt", "log2", 0.5, "3")] == [10, 10, 3, 3, 5, 3]


def test_vote_tie_takes_lowest_class(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0],), ([1.0, 1.0, 1.0, 0.0],)], "tree_predictions array<double>")
    assert [r["prediction"] for r in score.vote(df, ["a", "b"]).collect()] == ["a", "b"]


def test_metrics_of_absent_classes_and_constant_target(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    r = {x["label"]: x for x in metrics.class_report(df).collect()}
    assert r["b"]["recall"] == 0 and r["c"]["precision"] == 0 and r["a"]["support"] == 2
    assert metrics.confusion_matrix(df).count() == 9
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert metrics.regression_metrics(same).first()["r2"] == 0.0


def test_ranges_across_bucket_borders(spark):
    ids = [0, 1, 2, 5, 6, 9, *range(65530, 65545)]
    out = runlog.id_ranges(spark.createDataFrame([("g", i) for i in ids], "g string, i long"), "g", "i")
    assert sorted((r["start"], r["n"]) for r in out.collect()) == [(0, 3), (5, 2), (9, 1), (65530, 15)]


def test_ledger_old_form_and_bad_payload(spark):
    doc = '{"tasks":{"t1":{"latest_attempt_id":2,"attempts":{"1":{"attempt_id":1,"status":"FAILED"},"2":{"attempt_id":2,"status":"COMPLETED"}}},"t2":{"status":"RUNNING"}}}'
    out = runlog.flatten_ledger(spark.createDataFrame([(doc,)], "doc string"))
    assert sorted((r["task_id"], r["attempt_id"], r["status"]) for r in out.collect()) == [("t1", 1, "FAILED"), ("t1", 2, "COMPLETED"), ("t2", 1, "RUNNING")]
    bad = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2, 2)], "id int, v array<double>, r int, c int")
    with pytest.raises(Exception, match="payload size"):
        io.explode_payload(bad, "id", "v", "r", "c").collect()


def test_ml_forest_is_the_same_on_any_layout_and_scores_like_case(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b")).withColumn("y", (F.col("a") + 3 * F.col("b") > 60).cast("int"))
    config = grid.ForestConfig(3, 4, min_samples_split=30)
    one = train.fit_forest_ml(df.repartition(1), ["a", "b"], "y", config)
    two = train.fit_forest_ml(df.repartition(5), ["a", "b"], "y", config)
    key = lambda d: sorted(tuple(r) for r in d.select("tree_index", "node_id", "feature", "prediction").collect())
    assert key(one) == key(two)
    assert one.where("feature >= 0 and count < 30").isEmpty()
    nodes = [r.asDict() for r in one.collect()]
    both = score.predict_trees(df, one, ["a", "b"])
    for t in range(3):
        case = score.tree_case([r for r in nodes if r["tree_index"] == t], ["a", "b"])
        assert both.where(case != F.get("tree_predictions", F.lit(t))).isEmpty()


def test_sql_forest_learns(spark):
    df = spark.range(1500).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b")).withColumn("y", (F.col("a") > 48).cast("int"))
    nodes = train.fit_forest_sql(df, ["a", "b"], "y", grid.ForestConfig(3, 2, "none"), n_classes=2)
    out = score.predict(df, nodes, ["a", "b"], ["0", "1"])
    assert out.where(F.col("prediction") == F.col("y").cast("string")).count() > 1450


def test_missing_trees(spark):
    expected = spark.range(4).select(F.col("id").cast("int").alias("tree_index"))
    trees = spark.createDataFrame([(0, "COMPLETED"), (1, "COMPLETED"), (2, "FAILED")], "tree_index int, status string")
    nodes = spark.createDataFrame([(0,), (2,)], "tree_index int")
    assert sorted(r[0] for r in train.missing_trees(expected, trees, nodes).collect()) == [1, 2, 3]


def test_job_end_to_end(spark, tmp_path):
    df = spark.range(1200).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("s"))
    df = df.withColumn("y", F.when((F.col("a") > 48) | (F.col("s") == "even"), "yes").otherwise("no"))
    request = TrainingRequest("y", "classification", "row_id", 5, space={"max_depth": [1, 5], "max_features": ["none"]}, exact_split=True)
    r = train_job(spark, df, request, str(tmp_path))
    assert r.labels == ["no", "yes"] and r.experiments.count() == 2 and r.experiment_id.endswith("exp_001")
    assert r.test["accuracy"] > 0.95
    assert r.nodes.select("tree_index").distinct().count() == 5
    reg = registry.Registry(spark, str(tmp_path))
    assert reg.latest_run().first()["job_id"] == r.job_id
    reg.fail(r.job_id, r.experiment_id, "later")
    assert reg.job_status(r.job_id).first()["status"] == "FAILED" and reg.job_status(r.job_id).first()["model_id"] == f"model_{r.job_id}"
    stored = io.read_nodes(spark, str(tmp_path), f"model_{r.job_id}").count()
    io.write_nodes(r.nodes, str(tmp_path), f"model_{r.job_id}")
    assert io.read_nodes(spark, str(tmp_path), f"model_{r.job_id}").count() == stored
    assert io.read_split(spark, str(tmp_path), r.job_id, "test").count() > 0
    with pytest.raises(ValueError):
        io.read_split(spark, str(tmp_path), r.job_id, "other")


def test_request_rules(spark):
    ok = dict(target="y", task_type="classification", row_id="id")
    for bad in (dict(n_estimators=0), dict(validation_ratio=0), dict(validation_ratio=0.6, test_ratio=0.5), dict(task_type="x"), dict(target=" "), dict(scenario="zzz")):
        with pytest.raises(ValueError):
            validate.validate_request(TrainingRequest(**{**ok, **bad}))
    one = spark.createDataFrame([(1.0, "a")], "x double, y string")
    with pytest.raises(ValueError):
        validate.validate(one, "y", "classification")
