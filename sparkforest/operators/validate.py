"""Rules that a dataset, a request and a model have to pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkforest.operators.scenario import feature_names, resolve


@dataclass(frozen=True)
class DatasetSchema:
    target: str
    features: list[str]
    task_type: str
    label_mapping: dict[str, int] | None


def task(task_type: str) -> str:
    t = (task_type or "").strip().lower()
    if t not in ("classification", "regression"):
        raise ValueError(f"unknown task type {task_type!r}")
    return t


def validate(df: DataFrame, target: str, task_type: str) -> DatasetSchema:
    from sparkforest.operators.encode import class_labels

    t = task(task_type)
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    if not (features := feature_names(df, target)):
        raise ValueError("there is no feature")
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    if t == "regression":
        if not isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError("a regression target has to be numeric")
        return DatasetSchema(target, features, t, None)
    labels = class_labels(df, target)
    if len(labels) < 2:
        raise ValueError("classification needs two classes at least")
    return DatasetSchema(target, features, t, {x: i for i, x in enumerate(labels)})


def check_types(df: DataFrame, features: list[str]) -> None:
    """Features are numbers, booleans or strings; a date, a list or a struct is an error that names the column. A cast
    to a number would let timestamps in as seconds."""
    odd = [f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields if f.name in features and not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType))]
    if odd:
        raise ValueError(f"features have to be numbers, booleans or strings: {', '.join(odd)}")


#: What becomes of missing numbers (null, NaN): an error, a side of each split, or the median with an indicator column.
MISSING = ("error", "tree", "indicator_median")


def missing_counts(df: DataFrame, features: list[str]) -> dict[str, int]:
    """How many rows lack each feature; those that none lacks are left out. One pass."""
    if not features:
        return {}
    lacks = lambda c: F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
    row = df.agg(*[F.count(F.when(lacks(c), 1)).alias(str(i)) for i, c in enumerate(features)]).first()
    return {c: row[i] for i, c in enumerate(features) if row[i]}


def check_missing(df: DataFrame, features: list[str]) -> None:
    """No feature may lack a value: the error names the columns and how many rows lack them."""
    if found := missing_counts(df, features):
        raise ValueError("missing values: " + ", ".join(f"{c} ({n} rows)" for c, n in found.items()) + "; choose missing='tree' or 'indicator_median'")


def validate_request(request) -> None:
    task(request.task_type)
    if not (request.target or "").strip():
        raise ValueError("the target is blank")
    if request.n_estimators <= 0:
        raise ValueError("n_estimators has to be positive")
    check_ratios(request.validation_ratio, request.test_ratio)
    if request.validation_ratio == 0:
        raise ValueError("validation_ratio has to be positive: experiments are compared on it")
    resolve(request.scenario)
    if request.missing not in MISSING:
        raise ValueError(f"missing has to be one of {', '.join(MISSING)}")
    if request.categories not in ("error", "codes"):
        raise ValueError("categories has to be error or codes")
    if request.draws not in ("poisson", "exact") or (request.draws == "exact" and request.backend != "sql"):
        raise ValueError("draws has to be poisson, or exact with backend='sql'")
    if request.backend not in ("ml", "sql"):
        raise ValueError(f"unknown backend {request.backend!r}")
    if request.missing == "tree" and request.backend != "sql":
        raise ValueError("missing='tree' needs backend='sql'")


def check_ratios(validation: float, test: float) -> None:
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("ratios have to be at least 0 and sum to less than 1")


def class_check(df: DataFrame, target: str) -> DataFrame:
    n = F.countDistinct(F.col(target).cast("string"))
    return df.agg(n.alias("n_classes"), (n >= 2).alias("ok"))


def is_integer_encoded(df: DataFrame, column: str, n: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    y = F.col(column).cast("double")
    ok = (F.abs(y - F.round(y)) < tolerance) & (y >= 0) & (F.lit(True) if n is None else y < n)
    return df.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("integer_encoded"))


def check_predictions(predictions: DataFrame, labels: list[str], column: str = "prediction") -> DataFrame:
    """Predicted values that aren't a class label; has to be empty."""
    known = predictions.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    return predictions.join(F.broadcast(known), column, "left_anti")


def check_manifest(trees: DataFrame, n_estimators: int, job_id: str | None = None, experiment_id: str | None = None) -> None:
    """A manifest's trees are completed, of one job and one experiment (these, if given), and all there."""
    row = trees.where("status = 'COMPLETED'").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("j"), F.countDistinct("experiment_id").alias("e"), F.min("job_id").alias("job"), F.min("experiment_id").alias("experiment")).first()
    if not row["n"] or row["j"] != 1 or row["e"] != 1:
        raise ValueError("a manifest needs completed trees of one job and one experiment")
    if job_id not in (None, row["job"]) or experiment_id not in (None, row["experiment"]):
        raise ValueError("the trees belong to another job or experiment")
    if row["n"] != n_estimators:
        raise ValueError(f"{row['n']} trees are completed, {n_estimators} were asked for")
