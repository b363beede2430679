"""Published models: a manifest row with all that scoring needs, beside the trees; loading and inference by id."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.operators import encode, score, train
from sparkforest.operators.grid import ForestConfig
from sparkforest.operators.registry import Registry
from sparkforest.operators.scenario import missing_columns
from sparkforest.operators.validate import check_manifest, task
from sparkforest.sources import io


@dataclass(frozen=True)
class Model:
    model_id: str
    job_id: str
    experiment_id: str
    task_type: str
    target: str
    features: list[str]
    labels: list[str] | None
    vocab: dict[str, list[str]]
    config: ForestConfig
    metrics: dict
    nodes: DataFrame
    #: Medians of the training rows that stand for missing numbers, and the columns that have an indicator.
    fill: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    #: Columns that are encoded by codes, and the codes: see ``encode.category_codes``.
    coded: list[str] = field(default_factory=list)
    codes: DataFrame | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        """Raw rows in, predictions out: the model's vocabulary and medians encode them. No rows, or a missing column: an
        error. A missing value that no median fills goes where its split sends it, which is right where it knew none."""
        if gone := missing_columns(rows, [*self.vocab, *self.fill, *self.coded]):
            raise ValueError(f"missing columns: {gone}")
        if rows.isEmpty():
            raise ValueError("there are no rows to score")
        encoded = encode.one_hot(rows, self.vocab)
        if self.coded:
            encoded = encode.with_codes(encoded, self.codes, self.coded)
        if self.fill:
            encoded = encode.fill_missing(encoded, self.fill, self.indicators)
        return score.predict(encoded, self.nodes, self.features, self.labels)

    def infer(self, rows: DataFrame, row_id: str) -> DataFrame:
        """(model_id, task_type, row id, label or value): the record of an inference, one row for each row."""
        out = self.predict(rows)
        classify = self.labels is not None
        label = F.col("prediction") if classify else F.lit(None).cast("string")
        value = F.lit(None).cast("double") if classify else F.col("prediction")
        return out.select(F.lit(self.model_id).alias("model_id"), F.lit(self.task_type).alias("task_type"), row_id, label.alias("label"), value.alias("value"))


def publish(spark: SparkSession, root: str, model: Model, trees: DataFrame) -> None:
    """Append the model's manifest. The trees have to be complete, of one job and one experiment."""
    check_manifest(trees, model.config.n_estimators, model.job_id, model.experiment_id)
    if model.config.n_estimators < 1 or (task(model.task_type) == "classification") != (model.labels is not None):
        raise ValueError("labels and task type don't fit")
    row = (model.model_id, model.job_id, model.experiment_id, "READY", model.task_type, model.target, model.features, model.labels or [], json.dumps(model.vocab), json.dumps(asdict(model.config)), json.dumps(model.metrics), model.config.n_estimators, json.dumps(model.fill), model.indicators, model.coded)
    schema = "model_id string, job_id string, experiment_id string, status string, task_type string, target string, features array<string>, labels array<string>, vocab string, config string, metrics string, n_trees int, fill string, indicators array<string>, coded array<string>"
    Registry(spark, root).append("models", spark.createDataFrame([row], schema).withColumn("created_at", F.unix_timestamp().cast("double")))


def load_model(spark: SparkSession, root: str, model_id: str) -> Model:
    """A published model, in any session. Unknown ids, models that aren't ready and missing trees are errors."""
    row = Registry(spark, root).get("models", model_id).first()
    if row is None:
        raise KeyError(f"no model {model_id!r}")
    if row["status"] != "READY":
        raise ValueError(f"model {model_id!r} is {row['status']}")
    nodes = io.read_nodes(spark, root, model_id).drop("model_id")
    there = nodes.select("tree_index").distinct().count()
    if there != row["n_trees"]:
        raise ValueError(f"model {model_id!r} has {there} trees, {row['n_trees']} are in its manifest")
    found = row.asDict()  # older manifests lack some fields
    coded = list(found.get("coded") or [])
    labels = list(row["labels"]) if task(row["task_type"]) == "classification" else None
    return Model(model_id, row["job_id"], row["experiment_id"], row["task_type"], row["target"], list(row["features"]), labels, json.loads(row["vocab"]), ForestConfig(**json.loads(row["config"])), json.loads(row["metrics"]), nodes, json.loads(found.get("fill") or "{}"), list(found.get("indicators") or []), coded, io.read_codes(spark, root, model_id) if coded else None)


def score_requests(requests: DataFrame, root: str) -> DataFrame:
    """(request_id, row_no, model_id, label, value, error) for requests (request_id, model_id, values, n_rows, n_cols), each by
    the model that it names.

    All models of the requests are gone through at once, as node tables: requests meet the registry's READY models and
    their trees by joins, so neither the driver nor a task holds a model. A model that isn't there or ready, or whose
    features aren't as many as the request's columns, gives one row with an ``error``; so do sizes that don't fit.
    """
    spark = requests.sparkSession
    models = Registry(spark, root).models().select("model_id", F.col("status").alias("_s"), F.col("labels").alias("_labels"), F.col("task_type").alias("_task"), F.size("features").alias("_n"))
    models = train.stored(models)  # a row for each model, by whose size Spark chooses the join
    asked = requests.select("request_id", "model_id", "values", "n_rows", "n_cols").join(models, "model_id", "left")
    error = F.when(F.col("_s").isNull(), "no such model").when(F.col("_s") != "READY", F.concat(F.lit("model is "), "_s"))
    error = error.when(F.col("n_cols") != F.col("_n"), "the model has other features").when(F.size("values") != F.col("n_rows") * F.col("n_cols"), "payload size is not n_rows * n_cols")
    asked = train.stored(asked.withColumn("error", error).withColumn("_q", F.monotonically_increasing_id()))  # an id may come twice
    cut = F.transform(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1), lambda i: F.slice("values", i * F.col("n_cols").cast("int") + 1, F.col("n_cols").cast("int")))
    rows = asked.where("error is null and n_rows > 0").select("_q", "request_id", "model_id", "_labels", "_task", F.posexplode(cut).alias("row_no", "x"))
    trees = io.read_nodes(spark, root, None).join(train.stored(asked.select("model_id").distinct()), "model_id", "left_semi")
    each = rows.join(train.stored(trees.select("model_id", "tree_index").distinct()), "model_id")
    # A row's ends meet once, for both counts, in as many partitions as they need.
    ends = score.descend(each, trees, ["model_id", "tree_index"])
    ends = train.dealt(ends, ends.count(), "_q", "row_no").groupBy("_q", "request_id", "model_id", "row_no", "_labels", "_task", "prediction").agg(F.count("*").alias("n"))
    # Of equal votes, the lowest class; a mean of all trees.
    best = ends.groupBy("_q", "request_id", "model_id", "row_no", "_labels", "_task").agg(F.min(F.struct((-F.col("n")).alias("n"), "prediction")).alias("b"), (F.sum(F.col("n") * F.col("prediction")) / F.sum("n")).alias("mean"))
    classify = F.col("_task") == "classification"
    label = F.when(classify, F.element_at("_labels", F.col("b.prediction").cast("int") + 1))
    good = best.select("request_id", "row_no", "model_id", label.alias("label"), F.when(~classify, F.col("mean")).alias("value"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    bad = asked.where("error is not null").select("request_id", none.cast("int").alias("row_no"), "model_id", none.cast("string").alias("label"), none.cast("double").alias("value"), "error")
    return good.unionByName(bad)
