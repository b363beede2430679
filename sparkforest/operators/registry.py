"""Jobs, experiments and models as append-only rows; the state of a key is its last value in each field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_state(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: each field's last value that isn't null, by version. An aggregation, so a key with many
    rows is combined before it is shuffled."""
    rest = [c for c in df.columns if c not in (key, version)]
    return df.groupBy(key).agg(F.max(version).alias(version), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rest])


def select_best(experiments: DataFrame, task_type: str, metric: str = "auto") -> DataFrame:
    """The experiment of the highest score; of equal scores, the first in plan order."""
    name = ("accuracy" if task_type == "classification" else "r2") if metric == "auto" else metric
    if name not in experiments.columns:
        raise ValueError(f"no metric {name!r}")
    return experiments.where(F.col(name).isNotNull()).orderBy(F.desc(name), "ordinal").limit(1)


def build_manifest(trees: DataFrame) -> DataFrame:
    """(experiment_id, n_trees, trees): completed trees of each experiment, by index."""
    done = trees.where("status = 'COMPLETED'")
    return done.groupBy("experiment_id").agg(F.count("*").alias("n_trees"), F.array_sort(F.collect_list(F.struct("tree_index", "tree_id"))).alias("trees"))


def final_trees(expected: DataFrame, results: DataFrame, stored: DataFrame) -> DataFrame:
    """For each expected tree its result, else what is stored, if that is completed."""
    r = results.select("tree_index", F.struct(F.col("tree_id"), F.col("status")).alias("r"))
    s = stored.select("tree_index", F.struct(F.col("tree_id"), F.col("status")).alias("s"))
    both = expected.join(r, "tree_index", "left").join(s, "tree_index", "left").select("tree_index", F.coalesce("r", "s").alias("x"))
    return both.where("x.status = 'COMPLETED'").select("tree_index", F.col("x.tree_id").alias("tree_id"))


class Registry:
    """Tables of status rows below a folder. ``append`` adds a version; readers see the latest state."""

    KEYS = {"jobs": "job_id", "experiments": "experiment_id", "models": "model_id", "trees": "tree_id"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, kind: str, rows: DataFrame) -> None:
        rows.withColumn("version", F.unix_micros(F.current_timestamp())).write.mode("append").option("mergeSchema", "true").parquet(f"{self.root}/registry/{kind}")

    def _state(self, kind: str) -> DataFrame:
        return latest_state(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/registry/{kind}"), self.KEYS[kind], "version")

    def jobs(self) -> DataFrame:
        return self._state("jobs").orderBy("created_at")

    def experiments(self, job_id: str) -> DataFrame:
        return self._state("experiments").where(F.col("job_id") == job_id).orderBy("ordinal")

    def trees(self, experiment_id: str) -> DataFrame:
        return self._state("trees").where(F.col("experiment_id") == experiment_id).orderBy("tree_index")

    def record(self, kind: str, experiment_id: str, split: str) -> DataFrame:
        """Rows of ``metrics``, ``reports`` or ``confusion`` of an experiment's split; those written last."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/registry/{kind}").where((F.col("experiment_id") == experiment_id) & (F.col("split") == split))
        last = rows.agg(F.max("version").alias("version"))  # one row
        return rows.join(last, "version").drop("version")

    def models(self) -> DataFrame:
        return self._state("models").orderBy("model_id")

    def get(self, kind: str, key: str) -> DataFrame:
        return self._state(kind).where(F.col(self.KEYS[kind]) == key)

    def fail(self, job_id: str, experiment_id: str | None, message: str) -> None:
        if experiment_id:
            self.append("experiments", self.spark.createDataFrame([(experiment_id, job_id, "FAILED")], "experiment_id string, job_id string, status string"))
        self.append("jobs", self.spark.createDataFrame([(job_id, "FAILED", message)], "job_id string, status string, message string"))

    def job_status(self, job_id: str) -> DataFrame:
        return self.get("jobs", job_id)

    def latest_run(self) -> DataFrame:
        return self._state("jobs").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
