"""Hyper-parameter grids as a table, and parameter rules."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("max_depth", "max_features", "min_samples_split", "min_samples_leaf", "criterion")
DEFAULTS = {
    "classification": {"max_depth": [None], "max_features": ["sqrt"], "min_samples_split": [2], "min_samples_leaf": [1], "criterion": ["gini"]},
    "regression": {"max_depth": [None], "max_features": ["1.0"], "min_samples_split": [2], "min_samples_leaf": [1], "criterion": ["squared_error"]},
}
_TYPES = {"max_depth": "int", "min_samples_split": "int", "min_samples_leaf": "int"}


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 4
    max_depth: int | None = 5
    max_features: str | None = "sqrt"
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    criterion: str = "gini"
    bootstrap: bool = True
    seed: int = 42


def plan_grid(spark: SparkSession, job_id: str, space: dict, task_type: str) -> DataFrame:
    """All combinations, ``criterion`` varying fastest; an empty list takes its default; depths below 1 mean none."""
    df = spark.createDataFrame([(job_id,)], "job_id string")
    ordinal = F.lit(0)
    for axis in AXES:
        values = list(space.get(axis) or DEFAULTS[task_type][axis])
        if axis == "max_depth":
            values = [v if v and v > 0 else None for v in values]
        if axis == "min_samples_split":
            values = [max(2, v) for v in values]
        if axis == "min_samples_leaf":
            values = [max(1, v) for v in values]
        kind = _TYPES.get(axis, "string")
        items = F.array(*[F.lit(v if v is None or kind == "int" else str(v)).cast(kind) for v in values])
        df = df.select(*df.columns, F.posexplode(items).alias(f"_{axis}", axis))
        ordinal = ordinal * len(values) + F.col(f"_{axis}")
    df = df.withColumn("ordinal", ordinal)
    return df.select(F.format_string("%s_exp_%03d", "job_id", "ordinal").alias("experiment_id"), "job_id", "ordinal", *AXES)


def select_initial(grid: DataFrame) -> DataFrame:
    return grid.orderBy("ordinal").limit(1)


def resolve_max_features(value, n_features: int) -> int:
    """Features that a split looks at: all, the floor of a root or logarithm, a share, or a count; 1 at least."""
    text = str(value).strip().lower() if value is not None else ""
    if text in ("", "none", "null"):
        return n_features
    if text == "sqrt":
        return max(1, int(math.sqrt(n_features)))
    if text == "log2":
        return max(1, int(math.log2(n_features)))
    if text.isdigit():
        return min(n_features, max(1, int(text)))
    share = float(text)
    if not 0 < share <= 1:
        raise ValueError(f"max_features {value!r} is neither a share nor a count")
    return max(1, int(share * n_features))
