"""Resume by trees that their content names; missing values; types of features."""

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import encode, registry, score, train, validate
from sparkforest.plans.models import load_model
from sparkforest.plans.training import TrainingRequest
from sparkforest.plans.training import train as train_job
from sparkforest.sources import io
from sparkforest.streaming import streams


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 53 % 29).cast("double").alias("b"))
    return train.stored(df.withColumn("y", F.when((F.col("a") > 50) & (F.col("b") < 15), "yes").otherwise("no")))


def table(nodes):
    return sorted(tuple(r) for r in nodes.select("tree_index", "node_id", "feature", "threshold", "left", "right", "prediction", "count").collect())


def request(n=8, **more):
    return TrainingRequest("y", "classification", "row_id", n, **{"space": {"max_depth": [3]}, "backend": "sql", "wave": 3, **more})


def how(spark, root, result):
    return [r["how"] for r in registry.Registry(spark, root).trees(result.experiment_id).collect()]


def test_a_killed_job_grows_only_what_it_lacks(spark, rows, tmp_path, monkeypatch):
    root, write, waves = str(tmp_path), io.write_trees, []

    def dies(nodes, *where):
        if waves:
            raise RuntimeError("lost")
        waves.append(1)
        write(nodes, *where)

    monkeypatch.setattr(io, "write_trees", dies)
    with pytest.raises(RuntimeError, match="lost"):
        train_job(spark, rows, request(), root, job_id="j1")
    monkeypatch.setattr(io, "write_trees", write)
    grown, fit = [], train.fit_forest_sql
    monkeypatch.setattr("sparkforest.plans.training.fit_forest_sql", lambda *a, **k: (grown.extend(k["trees"]), fit(*a, **k))[1])
    r = train_job(spark, rows, request(), root, job_id="j1")
    assert grown == [3, 4, 5, 6, 7] and how(spark, root, r) == ["RESUMED"] * 3 + ["GROWN"] * 5
    monkeypatch.undo()
    assert table(r.nodes) == table(train_job(spark, rows, request(wave=None)).nodes)
    # More trees of the same forest: those that are there stay.
    more = train_job(spark, rows.repartition(5), request(9), root, job_id="j2")
    assert how(spark, root, more) == ["RESUMED"] * 8 + ["GROWN"] and table(more.nodes)[: len(table(r.nodes))] == table(r.nodes)
    fewer = train_job(spark, rows, request(2), root, job_id="j3")
    assert how(spark, root, fewer) == ["RESUMED"] * 2 and load_model(spark, root, fewer.model.model_id).nodes.select("tree_index").distinct().count() == 2


def test_half_a_tree_is_not_a_tree(spark, rows, tmp_path):
    nodes = train.fit_forest_sql(rows.withColumn("y", (F.col("y") == "yes").cast("int")), ["a", "b"], "y", train.ForestConfig(2, 3), n_classes=2)
    io.write_trees(nodes, str(tmp_path), "k")
    assert set(io.whole_trees(spark, str(tmp_path), "k")[1]) == {0, 1}
    sizes = nodes.groupBy("tree_index").agg(F.count("*").alias("n_nodes"))
    io._node_rows(nodes).join(sizes, "tree_index").where("not (tree_index = 1 and node_id = 2)").write.parquet(f"{tmp_path}/trees/half")
    found, whole = io.whole_trees(spark, str(tmp_path), "half")
    assert set(whole) == {0} and found.where("tree_index = 1").isEmpty()
    io.write_trees(nodes.where("tree_index = 1"), str(tmp_path), "half")
    assert set(io.whole_trees(spark, str(tmp_path), "half")[1]) == {0, 1}


@pytest.mark.parametrize("backend", ["sql", "ml"])
def test_another_request_or_data_shares_no_tree(spark, rows, tmp_path, backend):
    root = str(tmp_path)
    first = train_job(spark, rows, request(2, backend=backend), root, job_id="j1")
    flipped = rows.withColumn("y", F.when(F.col("y") == "yes", "no").otherwise("yes"))
    other = train_job(spark, flipped, request(2, backend=backend, seed=7, space={"max_depth": [6]}), root, job_id="j1")
    assert how(spark, root, other) == ["GROWN"] * 2 and other.test["accuracy"] > 0.8
    assert other.model.model_id != first.model.model_id
    for r in (first, other):
        m = load_model(spark, root, r.model.model_id)
        assert (m.config, table(m.nodes)) == (r.model.config, table(r.nodes))
    again = train_job(spark, rows, request(2, backend=backend), root, job_id="j1")
    assert how(spark, root, again) == ["RESUMED"] * 2 and again.test == first.test and again.model.model_id == first.model.model_id


def test_stored_trees_are_never_replaced(spark, rows, tmp_path):
    y = rows.withColumn("y", (F.col("y") == "yes").cast("int"))
    one, two = (train.fit_forest_sql(y, ["a", "b"], "y", train.ForestConfig(2, 3, seed=s), n_classes=2) for s in (1, 2))
    io.write_nodes(one.where("tree_index = 0"), str(tmp_path), "m")
    with pytest.raises(ValueError, match="other trees"):
        io.write_nodes(two, str(tmp_path), "m")
    io.write_nodes(one, str(tmp_path), "m")
    assert table(io.read_nodes(spark, str(tmp_path), "m")) == table(one)


def test_missing_values_are_an_error_by_default(spark, rows):
    holes = rows.withColumn("a", F.when(F.col("row_id") % 3 > 0, F.col("a"))).withColumn("b", F.when(F.col("row_id") % 300 > 0, F.col("b")).otherwise(float("nan")))
    for backend in ("ml", "sql"):
        with pytest.raises(ValueError, match=r"a \(200 rows\), b \(2 rows\)"):
            train_job(spark, holes, request(2, backend=backend))
    with pytest.raises(ValueError, match="sql"):
        train_job(spark, holes, request(2, backend="ml", missing="tree"))
    with pytest.raises(ValueError, match="one of"):
        train_job(spark, holes, request(2, missing="zero"))


@pytest.mark.parametrize(("missing", "backend"), [("tree", "sql"), ("indicator_median", "ml")])
def test_missing_values_teach_and_are_scored_alike(spark, tmp_path, missing, backend):
    """The label follows what is missing, so a model has to use it; batch, stored model and stream agree."""
    root = str(tmp_path)
    df = spark.range(600).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 10).cast("double")).alias("a"), (F.col("id") * 53 % 29).cast("double").alias("b"))
    df = train.stored(df.withColumn("y", F.when(F.col("a").isNull() | (F.col("b") > 20), "yes").otherwise("no")))
    r = train_job(spark, df, request(3, backend=backend, missing=missing, space={"max_depth": [5], "max_features": ["none"]}), root)
    assert r.test["accuracy"] > 0.97
    m = load_model(spark, root, r.model.model_id)
    assert (m.fill, m.indicators) == (r.model.fill, r.model.indicators)
    assert (r.features, m.indicators) == ((["a", "b", "a_missing"], ["a"]) if backend == "ml" else (["a", "b"], []))
    batch = r.predict(df).select("row_id", F.col("prediction").alias("p"))
    assert m.predict(df).join(batch, "row_id").where("p <> prediction").isEmpty()
    if missing == "tree":
        holes = df.select(F.col("row_id").alias("request_id"), F.array("a", "b").alias("values"), F.lit(1).alias("n_rows"), F.lit(2).alias("n_cols"))
        streamed = streams.predict_stream(holes, m.nodes, m.features, m.labels)
        assert streamed.join(batch, streamed["request_id"] == batch["row_id"]).where("p <> prediction").isEmpty()


def test_medians_are_exact_however_many_values(spark):
    """One more or one less of the lower half moves the middle, far below one rank in 10,000 of 100,000."""
    half = spark.range(100_000).select(F.when(F.col("id") < 50_000, 1.0).otherwise(2.0).alias("even"), F.when(F.col("id") < 49_999, 1.0).otherwise(2.0).alias("more"), (F.col("id") * 7 % 100_000 / 8).alias("all"))
    assert encode.medians(half, ["even", "more", "all"]) == {"even": 1.0, "more": 2.0, "all": 49_999 / 8}


def test_medians_and_indicators(spark):
    df = spark.createDataFrame([(1.0, 5, "x"), (None, 6, "x"), (float("nan"), None, "y"), (3.0, 8, "z"), (9.0, 9, "z")], "a double, b int, s string")
    assert encode.medians(df, ["a", "b"]) == {"a": 3.0, "b": 6.0} and encode.medians(df, []) == {}
    assert encode.medians(df.where("b > 100"), ["a"]) == {"a": 0.0}
    out = [tuple(r) for r in encode.fill_missing(df, {"a": 3.0, "b": 6.0}, ["a"]).collect()]
    assert out == [(1.0, 5.0, "x", 0.0), (3.0, 6.0, "x", 1.0), (3.0, 6.0, "y", 1.0), (3.0, 8.0, "z", 0.0), (9.0, 9.0, "z", 0.0)]
    with pytest.raises(ValueError, match="clash"):
        encode.fill_missing(df.withColumn("A_missing", F.lit(1)), {"a": 0.0}, ["a"])
    assert validate.missing_counts(df, ["a", "b"]) == {"a": 2, "b": 1}


@pytest.mark.parametrize("kind", ["timestamp", "date", "array<int>", "struct<x:int>", "binary"])
def test_features_of_other_types_are_an_error(spark, rows, kind):
    odd = rows.withColumn("odd", F.lit(None).cast(kind))
    with pytest.raises(ValueError, match=rf"odd \({kind}\)"):
        train_job(spark, odd, request(1))


def test_nodes_of_a_table_without_the_column_score(spark):
    nodes = spark.createDataFrame([(0, 1, 0, 0.5, 2, 3, 0.0, 2.0, 0.1), (0, 2, -1, None, -1, -1, 0.0, 1.0, 0.0), (0, 3, -1, None, -1, -1, 1.0, 1.0, 0.0)], train.NODES)
    out = score.predict(spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double"), nodes, ["x"], ["l", "r"])
    assert [r["prediction"] for r in out.collect()] == ["l", "r", "r"]
