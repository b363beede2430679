"""The experiments of a grid, grown and measured together, are those that run alone."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators import grow, registry, train
from sparkforest.operators.grid import ForestConfig
from sparkforest.plans import training
from sparkforest.plans.training import TrainingRequest
from sparkforest.plans.training import train as train_job


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("a"), (F.col("id") * 53 % 29).cast("double").alias("b"))
    y = F.when((F.coalesce("a", F.lit(70.0)) > 50) & (F.col("b") < 15), 1).otherwise(0)
    return train.stored(df.withColumn("y", y).withColumn("v", F.col("b") * 2 + F.col("row_id") % 5))


def table(nodes):
    return sorted((tuple(r) for r in nodes.select("tree_index", "node_id", "feature", "threshold", "left", "right", "prediction", "count", "gain", "missing_left").collect()), key=lambda r: r[:2])


GRIDS = [
    ("y", 2, 8, [ForestConfig(2, 2, "1"), ForestConfig(2, None, "2", 9, 2, "entropy"), ForestConfig(3, 1, "2", 2, 40)], [None, [1], None]),
    ("v", None, None, [ForestConfig(1, 2, "2", criterion="squared_error"), ForestConfig(2, 1, "1", 50, 5, "squared_error")], None),
]


@pytest.mark.parametrize(("target", "classes", "bins", "configs", "trees"), GRIDS)
def test_together_as_alone(spark, rows, target, classes, bins, configs, trees):
    """Other depths, criteria, numbers of features and least rows, and single trees, over levels and in tasks."""
    both = train.stored(grow.grow_grid(rows, ["a", "b"], target, configs, n_classes=classes, bins=bins, trees=trees, finish=60))
    for e, config in enumerate(configs):
        alone = train.fit_forest_sql(rows, ["a", "b"], target, config, n_classes=classes, bins=bins, trees=trees and trees[e], finish=60)
        assert table(alone) == table(both.where(F.col("experiment") == e))


def test_passes_over_the_rows_do_not_grow_with_the_grid(spark, rows, monkeypatch):
    """Tables that growing writes over the levels (no node is finished in a task): as many for four experiments as for one."""
    def written(configs):
        count, write = [0], train.stored
        monkeypatch.setattr(train, "stored", lambda df: (count.__setitem__(0, count[0] + 1), write(df))[1])
        grow.grow_grid(rows, ["a", "b"], "y", configs, n_classes=2, bins=8, finish=0)
        monkeypatch.undo()
        return count[0]

    assert written([ForestConfig(1, 2, "2")]) == written([ForestConfig(1, 2, k, min_samples_leaf=n) for k in ("1", "2") for n in (1, 3)])


def test_other_seeds_and_no_rows(spark, rows):
    with pytest.raises(ValueError, match="seed"):
        grow.grow_grid(rows, ["a"], "y", [ForestConfig(seed=1), ForestConfig(seed=2)], n_classes=2)
    assert grow.grow_grid(rows.limit(0), ["a"], "y", [ForestConfig(2, 2)] * 2, n_classes=2).collect() == []


def test_a_job_grows_its_grid_in_waves_and_resumes_it(spark, rows, tmp_path, monkeypatch):
    """One growth for each wave, whatever the grid; metrics as each experiment's own; a wider grid grows what is new."""
    df, root, asked, real = rows.drop("v", "a").withColumn("y", F.col("y").cast("string")), str(tmp_path), [], grow.grow_grid
    ask = lambda depths: TrainingRequest("y", "classification", "row_id", 3, space={"max_depth": depths, "max_features": ["2"]}, backend="sql", wave=2)
    monkeypatch.setattr(training.grow, "grow_grid", lambda *a, **k: (asked.append(k["trees"]), real(*a, **k))[1])
    first = train_job(spark, df, ask([1, 2]), root)
    assert asked == [[[0, 1], [0, 1]], [[2], [2]]]
    asked.clear()
    wider = train_job(spark, df, ask([1, 2, 3]), root)
    assert asked == [[[0, 1]], [[2]]]  # the third experiment's
    how = {e["experiment_id"]: [r["how"] for r in registry.Registry(spark, root).trees(e["experiment_id"]).collect()] for e in wider.experiments.collect()}
    assert sorted(map(tuple, how.values())) == [("GROWN",) * 3, ("RESUMED",) * 3, ("RESUMED",) * 3]
    found = {r["ordinal"]: r["accuracy"] for r in wider.experiments.collect()}
    assert {r["ordinal"]: r["accuracy"] for r in first.experiments.collect()} == {k: found[k] for k in (0, 1)}
    assert isinstance(wider.nodes, DataFrame) and found[2] >= found[0]


@pytest.mark.parametrize(("target", "labels", "kind"), [("y", ["0", "1"], "classification"), ("v", None, "regression")])
def test_measured_together_as_alone(spark, rows, target, labels, kind):
    configs = [ForestConfig(n, d, "2", criterion="gini" if labels else "squared_error") for n, d in ((1, 1), (3, 2))]
    ready = rows.withColumn("label", F.col(target).cast("double"))
    forests = [train.stored(train.fit_forest_sql(rows, ["a", "b"], target, c, n_classes=2 if labels else None)) for c in configs]
    together = training.measure_each(ready, forests, [1, 3], ["a", "b"], labels, kind)
    for own, nodes in zip(together, forests):
        alone = training.measure(ready, nodes, ["a", "b"], labels, kind)
        assert {k: own[k] for k in alone} == pytest.approx(alone)
