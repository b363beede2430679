"""Shared helpers: scratch tables in the cluster's shared folder, distributed running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, one below the warehouse, if executors share it: a
    folder of the driver's machine is an error, unless the driver is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if (base.startswith("/") or base.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{base.rstrip('/')}/sparkforest-scratch"
    return f"{base.rstrip('/')}/sparkforest-{uuid.uuid4().hex}"


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as it is the name of a column."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


#: Whether a query's shuffle files go when it ends (Spark 4.1 on), instead of some time after the driver's JVM has
#: collected what names them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage: each is written to the shared folder and read back.

    A table that is written needs its shuffles no more, so these go: a job holds those of one step, and not of all.
    ``drop`` removes one that is no longer read, so that loops don't pile up files.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def store(self, df: DataFrame) -> DataFrame:
        path, conf = scratch_path(self.spark), self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch at most: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def first_by_hash(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(group, key, ``_n``): the first ``n`` rows of each group by the order of a hash of ``key``, numbered from 1.

    Groups are few (labels, languages) and may be of any size: rows far down the order of their group are left
    out by a threshold on the hash before any is gathered, so that about 1.5 ``n`` of a group meet in one task.
    """
    keyed = rows.select(group, key).withColumn("_u", F.pmod(F.xxhash64(key), F.lit(1 << 32)))
    sizes = {r[group]: r["count"] for r in keyed.groupBy(group).count().collect() if r[group] is not None}
    margin = 1.5
    while True:
        few = keyed.where(F.lit(False))
        if sizes:
            least = F.create_map(*[F.lit(x) for g, size in sizes.items() for x in (g, int((1 << 32) * min(1.0, (margin * n + 100) / size)))])
            few = keyed.where(F.col("_u") < F.element_at(least, F.col(group)))
        there = {r[group]: r["count"] for r in few.groupBy(group).count().collect()}
        if all(there.get(g, 0) >= min(n, size) for g, size in sizes.items()):
            break
        margin *= 2  # repeated keys may crowd the rest of the order
    order = Window.partitionBy(group).orderBy("_u", key)
    return few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(group, key, "_n")


def numbered_runs(value: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over range-sorted partitions: adds the partition (``_part``), the place in it
    (``_idx``) and the running total of ``value`` in it (``_run``)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            run = b[value].cumsum() + total
            idx = pd.RangeIndex(seen, seen + len(b)).to_numpy()
            if len(b):
                total, seen = int(run.iloc[-1]), seen + len(b)
            yield b.assign(_part=part, _idx=idx, _run=run)

    return add


def running_total(scratch: Scratch, df: DataFrame, order: list, value: str) -> DataFrame:
    """Adds ``_part``, ``_idx`` (together the global order) and ``_run``, the global running total of
    ``value`` in that order. Range-sorts the rows; only one row per partition is gathered for the offsets."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = scratch.store(ranged.mapInPandas(numbered_runs(value), f"{fields}, _part int, _idx long, _run long"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = local.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    parts = parts.select("_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    out = local.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    out = out.select(*df.columns, "_part", "_idx", (F.col("_run") + F.col("_before")).alias("_run"))
    out._scratch_path = local._scratch_path
    return out
