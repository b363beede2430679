"""Work that grows with a table goes to more tasks, not to larger ones."""

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import grow, runlog, train
from sparkforest.operators.grid import ForestConfig
from sparkforest.sources import io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(train, "PARTITION_ROWS", 50, raising=False)


def test_id_ranges(spark, small_parts):
    ids = spark.range(2000).select((F.col("id") % 2).alias("g"), (65_000 + F.floor(F.col("id") / 4) * F.when(F.col("id") % 2 == 0, 1).otherwise(3)).cast("long").alias("i"))
    out = runlog.id_ranges(ids, "g", "i")  # each id twice, over the border of a bucket
    assert "40), REPARTITION_BY_NUM" in plan(out)
    assert sorted(map(tuple, out.collect())) == [(0, 65_000, 500), *((1, 65_000 + 3 * k, 1) for k in range(500))]


def test_payloads(spark, small_parts):
    cells = spark.range(1000).select(F.floor(F.col("id") / 4).alias("q"), (F.col("id") % 4).alias("r"), F.col("id").cast("double").alias("x"))
    out = io.pack_payload(cells, "q", "r", ["x"])
    assert "20), REPARTITION_BY_NUM" in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(q, [4.0 * q + i for i in range(4)], 4, 1) for q in range(250)]


def test_forest_is_the_same_however_often_places_are_written(spark, monkeypatch):
    rows = train.stored(spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 53 % 29).cast("double").alias("b")))
    rows = train.stored(rows.withColumn("y", ((F.col("a") > 50).cast("int") + (F.col("b") < 15).cast("int")) % 2))

    def forest(levels):
        monkeypatch.setattr(grow, "LEVELS", levels)
        return sorted(map(tuple, grow.grow_forest(rows, ["a", "b"], "y", ForestConfig(2, 3), n_classes=2, finish=5).collect()))

    assert forest(4) == forest(2)
