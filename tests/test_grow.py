"""Forests by aggregation: missing values, exact cuts, any depth, single trees, subtrees in tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkforest.operators import score, split, train
from sparkforest.operators.grid import ForestConfig

FIELDS = ("tree_index", "node_id", "feature", "threshold", "left", "right", "prediction", "count", "gain", "missing_left")


@pytest.fixture(scope="module")
def rows(spark):
    """Two numbers with ties and missing values, a label that both decide, and a target."""
    df = spark.range(700).select(F.col("id").alias("row_id"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("a"), F.when(F.col("id") % 7 == 3, float("nan")).otherwise((F.col("id") * 53 % 29).cast("double")).alias("b"))
    y = F.when(F.col("a").isNull(), 2).when((F.col("a") > 50) & (F.col("b") < 15), 1).otherwise(0)
    return train.stored(df.withColumn("y", y).withColumn("v", (F.coalesce("a", F.lit(200.0)) * 3 + F.nanvl("b", F.lit(5.0))).cast("long").cast("double")))


def table(nodes):
    return sorted((tuple(r[c] for c in FIELDS) for r in nodes.collect()), key=lambda r: r[:2])


def shape(nodes):
    """Trees without their node numbers, from the root down."""
    by = {(r["tree_index"], r["node_id"]): r for r in nodes.collect()}

    def at(t, i):
        r = by[t, i]
        own = (r["feature"], r["threshold"], r["prediction"], r["count"], r["gain"], r["missing_left"])
        return own if r["feature"] < 0 else (own, at(t, r["left"]), at(t, r["right"]))

    return {t: at(t, 1) for t in {t for t, _ in by}}


@pytest.mark.parametrize(("target", "classes", "criterion", "bins"), [("y", 3, "gini", None), ("y", 3, "entropy", 8), ("v", None, "squared_error", None)])
def test_subtrees_in_tasks_are_those_of_levels(spark, rows, target, classes, criterion, bins):
    config = ForestConfig(2, 3, "1", criterion=criterion, min_samples_leaf=2, min_samples_split=6)
    fit = lambda finish: train.fit_forest_sql(rows, ["a", "b"], target, config, n_classes=classes, bins=bins, finish=finish)
    tasks, mixed = fit(10**9), fit(100 if bins else 0)
    assert shape(tasks) == shape(mixed)
    for nodes in (tasks, mixed):
        ids = {(r["tree_index"], r["node_id"]) for r in nodes.collect()}
        assert ids == {(t, i) for t in (0, 1) for i in range(1, 1 + sum(x == t for x, _ in ids))}  # without holes


def plain_root(x, y, classes):
    """(gain, threshold, missing_left) of the best cut by trying all, in the stated order."""
    def gini(v):
        return 1 - sum((np.mean(v == c) ** 2 for c in range(classes)), 0.0) if len(v) else 0.0

    lacks, best = np.isnan(x), None
    values = sorted(set(x[~lacks]))
    for k, value in enumerate(values):
        for left in (False, True) if lacks.any() else (False,):
            go = np.where(lacks, left, x <= value)
            if 0 < go.sum() < len(x):
                gain = gini(y) - (go.sum() * gini(y[go]) + (~go).sum() * gini(y[~go])) / len(x)
                cut = np.inf if k + 1 == len(values) else (value + values[k + 1]) / 2
                if best is None or round(gain, 9) > round(best[0], 9):
                    best = (gain, cut, left if lacks.any() else bool(go.sum() >= (~go).sum()))
    return best


@pytest.mark.parametrize(("feature", "finish"), [("a", 0), ("b", 10**9), ("b", 0)])
def test_root_tries_missing_values_on_both_sides(spark, rows, finish, feature):
    pdf = rows.toPandas()
    gain, cut, left = plain_root(pdf[feature].to_numpy(float), pdf["y"].to_numpy(), 3)
    nodes = train.fit_forest_sql(rows, [feature], "y", ForestConfig(1, 1, bootstrap=False), n_classes=3, bins=None, finish=finish)
    root = nodes.where("node_id = 1").first()
    assert root["gain"] == pytest.approx(gain, abs=2e-9) and (root["threshold"], root["missing_left"]) == (cut, left)


def test_only_missing_values_part(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 > 0, F.lit(1.0)).alias("a"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    for finish, bins in ((0, None), (100, None), (100, 4)):
        nodes = train.fit_forest_sql(df, ["a"], "y", ForestConfig(1, 3, bootstrap=False), n_classes=2, bins=bins, finish=finish)
        root = nodes.where("node_id = 1").first()
        assert (root["threshold"], root["missing_left"], nodes.count()) == (float("inf") if bins is None else root["threshold"], False, 3)
        out = score.predict(df, nodes, ["a"], ["0", "1"])
        assert out.where(F.col("prediction") != F.col("y").cast("string")).isEmpty()


def test_scorer_and_case_send_missing_values_alike(spark, rows):
    nodes = train.fit_forest_sql(rows, ["a", "b"], "y", ForestConfig(3, 5), n_classes=3)
    out = score.predict_trees(rows, nodes, ["a", "b"])
    for t in range(3):
        case = score.tree_case([r.asDict() for r in nodes.where(F.col("tree_index") == t).collect()], ["a", "b"])
        assert out.where(case != F.get("tree_predictions", F.lit(t))).isEmpty()
    assert score.predict(rows, nodes, ["a", "b"], ["0", "1", "2"]).where(F.col("prediction") == F.col("y").cast("string")).count() > 650


@pytest.mark.parametrize("finish", [58, 10**9])
def test_a_chain_grows_to_depth_60(spark, finish):
    """Targets that grow eightfold: each cut parts the largest from the rest."""
    df = spark.range(66).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.pow(F.lit(8.0), F.col("id")).alias("v"))
    nodes = train.fit_forest_sql(df, ["a"], "v", ForestConfig(1, None, bootstrap=False, criterion="squared_error"), n_classes=None, bins=None, finish=finish)
    by = {r["node_id"]: r for r in nodes.collect()}

    def deep(i):
        return 0 if by[i]["feature"] < 0 else 1 + max(deep(by[i]["left"]), deep(by[i]["right"]))

    assert deep(1) >= 60 and len(by) == 2 * 66 - 1
    assert score.predict(df, nodes, ["a"], None).where("abs(prediction - v) > 1e-9 * v").isEmpty()


def test_single_trees_are_those_of_the_forest(spark, rows):
    config = ForestConfig(5, 4)
    whole = table(train.fit_forest_sql(rows, ["a", "b"], "y", config, n_classes=3, finish=50))
    some = table(train.fit_forest_sql(rows.repartition(7), ["a", "b"], "y", config, n_classes=3, finish=50, trees=[1, 4]))
    assert some == [r for r in whole if r[0] in (1, 4)]
    assert {r["tree_index"] for r in split.bootstrap_weights(rows, "row_id", 5, 42, only=[3]).select("tree_index").distinct().collect()} == {3}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_shares_are_cut_by_counts(spark, share):
    """Rows of one value, some with equal ids, and a class with a single row."""
    rows = [(f"r{i % 60}", "a" if i % 3 else "b", i % 7 if i < 50 else (i * 2654435761) % 2**32) for i in range(150)] + [("x", "c", 5)]
    df = spark.createDataFrame(rows, "row_id string, y string, h long")
    out = split._first_share(df, F.lit(True), F.col("y"), "h", share, "row_id", "first").collect()
    assert len(out) == len(rows)
    for y in "abc":
        own = sorted((h, i) for i, s, h in rows if s == y)
        n = int(np.ceil(len(own) * share - 1e-9))
        assert sorted((r["h"], r["row_id"]) for r in out if r["y"] == y and r["first"]) == own[:n]


def test_exact_draws(spark, rows, monkeypatch):
    """n draws on any partitioning and of single trees, over one range or many, spread as a multinomial draw is."""
    assert split.exact_bootstrap(rows.limit(0), "row_id", 2, 1).collect() == []
    for size in (split.RANGE_ROWS, 20):
        monkeypatch.setattr(split, "RANGE_ROWS", size)
        key = lambda d: sorted((r["tree_index"], r["row_id"], r["weight"]) for r in d.collect())  # noqa: E731, B023
        one, two = key(split.exact_bootstrap(rows.coalesce(1), "row_id", 3, 42)), key(split.exact_bootstrap(rows.repartition(9), "row_id", 3, 42))
        assert one == two and [sum(w for t, _, w in one if t == i) for i in range(3)] == [700] * 3
        assert key(split.exact_bootstrap(rows, "row_id", 3, 42, only=[2])) == [x for x in one if x[0] == 2]
        out = [700 - sum(t == i for t, *_ in one) for i in range(3)]
        assert all(abs(n - 700 / np.e) < 6 * (700 * 0.1) ** 0.5 for n in out)
    upto = np.append(0, np.cumsum([5, 0, 7, 100]))
    assert sum(split.range_draws(i, upto, 9) for i in range(4)) == 112 and split.range_draws(1, upto, 9) == 0
    nodes = train.fit_forest_sql(rows, ["a", "b"], "y", ForestConfig(2, 2), n_classes=3, draws="exact")
    assert [r["count"] for r in nodes.where("node_id = 1").collect()] == [700.0, 700.0]
