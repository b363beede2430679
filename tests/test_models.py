import pytest
from pyspark.sql import functions as F

from sparkforest.operators import registry, runlog, scenario, score, split
from sparkforest.operators.grid import ForestConfig
from sparkforest.operators.train import depth_of
from sparkforest.plans.models import load_model
from sparkforest.plans.training import TrainingRequest, compare_scenarios, train


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("s"))
    return df.withColumn("y", F.when((F.col("a") > 48) | (F.col("s") == "even"), "yes").otherwise("no")).withColumn("v", F.col("a") * 2)


def test_presets_keep_the_order_of_their_lists(spark):
    names = ("y", "glucose_postprandial", "bmi", "hba1c", "diabetes_stage", "insulin_level", "glucose_fasting", "diabetes_risk_score")
    df = spark.range(1).select(*[F.lit(1).alias(n) for n in names])
    out = {p: scenario.apply_scenario(df, "y", p)[0].columns for p in scenario.PRESETS}
    assert out["glucose_only"] == ["hba1c", "glucose_fasting", "glucose_postprandial", "y"]
    assert out["clinical_only"] == ["bmi", "insulin_level", "y"]
    assert out["no_diagnostic_features"] == ["y", "bmi", "insulin_level"] and out["no_diagnostic_extended"] == ["y", "bmi"]
    assert out["baseline_original"] == out["baseline_no_leakage"] == list(names)


def test_error_markers(spark):
    texts = [*runlog.TIMEOUT, *runlog.WORKER_FAILURE, "deadline", "connection", "", None, "worker timed out", "  RPC  "]
    want = ["timeout"] * 3 + ["worker_failure"] * 7 + ["unknown"] * 4 + ["timeout", "worker_failure"]
    got = spark.createDataFrame([(i, t and t.upper()) for i, t in enumerate(texts)], "i int, t string").select("i", runlog.error_category(F.col("t")).alias("c")).orderBy("i")
    assert [r["c"] for r in got.collect()] == want


def test_published_model_loads_and_scores_by_id(spark, rows, tmp_path):
    df, root = rows.drop("v"), str(tmp_path)
    request = TrainingRequest("y", "classification", "row_id", 3, space={"max_depth": [4]}, exact_split=True)
    r = train(spark, df, request, root)
    m = load_model(spark, root, r.model.model_id)
    assert (m.labels, m.features, m.config, m.task_type) == (r.labels, r.features, r.model.config, "classification")
    same = m.predict(df).select("row_id", F.col("prediction").alias("p")).join(r.predict(df), "row_id")
    assert same.where("p <> prediction").isEmpty() and same.count() == 900
    record = m.infer(df, "row_id")
    assert record.columns == ["model_id", "task_type", "row_id", "label", "value"] and record.where("label is null or value is not null").isEmpty()
    with pytest.raises(KeyError):
        load_model(spark, root, "model_other")
    with pytest.raises(ValueError):
        m.predict(df.limit(0))
    with pytest.raises(ValueError):
        m.predict(df.drop("s"))
    reg = registry.Registry(spark, root)
    assert [t["seed"] for t in reg.trees(r.experiment_id).collect()] == [42, 43, 44]
    report = {x["label"]: x for x in reg.record("reports", r.experiment_id, "test").collect()}
    assert set(report) == {"no", "yes", "macro avg", "weighted avg"}
    assert reg.record("confusion", r.experiment_id, "test").agg(F.sum("n")).first()[0] == report["macro avg"]["support"] == 181  # rounded up in each class
    assert reg.record("metrics", r.experiment_id, "validation").first()["accuracy"] == r.validation["accuracy"]
    again = train(spark, df, request, root, job_id=r.job_id)
    assert {t["how"] for t in reg.trees(r.experiment_id).collect()} == {"RESUMED"} and again.test == r.test
    assert reg.job_status(r.job_id).first()["status"] == "COMPLETED"


def test_failed_job_leaves_its_state(spark, rows, tmp_path):
    with pytest.raises(ValueError):
        train(spark, rows.where("y = 'yes'"), TrainingRequest("y", "classification", "row_id"), str(tmp_path))
    state = registry.Registry(spark, str(tmp_path)).jobs().first()
    assert state["status"] == "FAILED" and "two classes" in state["message"]


def test_regression_job_and_scenarios(spark, rows):
    r = train(spark, rows.drop("y"), TrainingRequest("v", "regression", "row_id", 3, space={"max_depth": [5]}))
    assert r.test["r2"] > 0.9 and r.validation["accuracy"] is None and r.labels is None
    got = compare_scenarios(spark, rows.drop("v"), TrainingRequest("y", "classification", "row_id", 3, space={"max_depth": [4]}, leakage=["s"]), ["baseline_original", "baseline_no_leakage"]).collect()
    assert [x["scenario"] for x in got] == ["baseline_original", "baseline_no_leakage"] and got[0]["accuracy"] > got[1]["accuracy"]


def test_second_split_has_its_own_rule(spark):
    """Two rows of a class are enough to stratify the test rows, but not the validation rows after them."""
    df = spark.range(40).select("id", F.when(F.col("id") < 2, "few").otherwise("many").alias("y"))
    out = split.assign_splits(df, validation_ratio=0.4, test_ratio=0.5, seed=1, row_id="id", target="y", task_type="classification", exact=True)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"test": 20, "validation": 16, "train": 4} and out.where("split = 'test' and y = 'few'").count() == 1


def test_depth_and_distribution_rules(spark):
    assert depth_of(ForestConfig(max_depth=30)) == 30
    with pytest.raises(ValueError):
        depth_of(ForestConfig(max_depth=31))
    with pytest.warns(UserWarning):
        assert depth_of(ForestConfig(max_depth=None)) == 30
    held = spark.createDataFrame([("a",), ("a",), ("b",)], "w string")
    assert tuple(runlog.evenly_distributed(held, "w").first()) == (2, 3, 1, 2, True)
    assert tuple(runlog.evenly_distributed(held, "w", 3).first()) == (3, 3, 0, 2, False)


def test_groups_of_trees_score_as_one(spark, rows, monkeypatch):
    r = train(spark, rows.drop("v"), TrainingRequest("y", "classification", "row_id", 3, space={"max_depth": [4]}))
    whole = r.predict(rows).select("row_id", F.col("tree_predictions").alias("t"))
    monkeypatch.setattr(score, "GROUP_NODES", 1)
    assert r.predict(rows).join(whole, "row_id").where("tree_predictions <> t").isEmpty()


def test_scenarios_share_what_they_have_in_common(spark, rows, monkeypatch):
    """One preparation serves the scenarios whose columns another has, and each measures what a job of its own does."""
    from sparkforest.operators.scenario import Scenario
    from sparkforest.plans import training

    request = TrainingRequest("y", "classification", "row_id", 3, space={"max_depth": [2, 4]}, leakage=["s"])
    names = [c for c in rows.columns if c not in ("row_id", "y")]
    scenarios = [Scenario(keep=(names[1], names[0]), name="two"), "baseline_no_leakage", "baseline_original"]
    alone = [train(spark, rows.drop("v"), TrainingRequest(**{**request.__dict__, "scenario": s})) for s in scenarios]
    calls, plain = [], split.assign_splits
    monkeypatch.setattr(training.split, "assign_splits", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = training.compare_scenarios(spark, rows.drop("v"), request, scenarios).collect()
    assert [r["n_features"] for r in got] == [len(x.features) for x in alone] and [r["accuracy"] for r in got] == [x.validation["accuracy"] for x in alone]
    assert len(calls) == 1
