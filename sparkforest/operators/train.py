"""Random forests as node tables: from Spark's own trainer, or grown by DataFrame aggregation.

Nodes: (tree_index, node_id, feature, threshold, left, right, prediction, count, gain, missing_left). A leaf's feature is
-1. A row without a value goes left where ``missing_left`` is true, else right; a table may lack that column.
"""

from __future__ import annotations

import os
import uuid
import warnings

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.operators.grid import ForestConfig, resolve_max_features

#: Depth of "no limit": what the trainer takes at most.
MAX_DEPTH = 30
IMPURITY = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy", "squared_error": "variance", "variance": "variance"}
NODES = "tree_index int, node_id int, feature int, threshold double, left int, right int, prediction double, count double, gain double"


def scratch(spark) -> str:
    """A new folder below ``spark.checkpoint.dir``, else below the warehouse, if executors share it: a folder of the
    driver's machine is an error, unless the driver is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if (base.startswith("/") or base.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/forest-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, which cuts the lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition, about, where the number of partitions goes by that of rows.
PARTITION_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` shuffled by ``by``, into as many partitions as ``rows`` rows need, and the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // PARTITION_ROWS)), *by)


def depth_of(config: ForestConfig) -> int:
    """The depth to grow to. More than MAX_DEPTH is an error; no limit means MAX_DEPTH, with a warning."""
    if config.max_depth is None:
        warnings.warn(f"trees without a depth limit are grown to depth {MAX_DEPTH}", stacklevel=3)
        return MAX_DEPTH
    if config.max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {config.max_depth} is over {MAX_DEPTH}")
    return config.max_depth


def impurity(config: ForestConfig, classification: bool) -> str:
    name = IMPURITY.get(config.criterion)
    if name is None or (name == "variance") == classification:
        raise ValueError(f"criterion {config.criterion!r} doesn't fit the task")
    return name


def laid_out(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows dealt by ``row_id`` and sorted by it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_id).sortWithinPartitions(row_id)


def fit_forest_ml(df: DataFrame, features: list[str], target: str, config: ForestConfig, *, classification: bool = True, row_id: str = "row_id", laid: bool = False) -> DataFrame:
    """Node table of a forest by Spark's trainer. Rows are laid out by ``row_id`` first, unless they are ``laid``: the
    trainer's sampling depends on the layout, so the same data and seed give the same forest whatever came before."""
    spark = df.sparkSession
    rows = df if laid else laid_out(df, row_id)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select("_x", F.col(target).cast("double").alias("_y"))
    kind = RandomForestClassifier if classification else RandomForestRegressor
    model = kind(
        featuresCol="_x", labelCol="_y", numTrees=config.n_estimators, maxDepth=depth_of(config), impurity=impurity(config, classification),
        featureSubsetStrategy=str(resolve_max_features(config.max_features, len(features))), minInstancesPerNode=max(1, config.min_samples_leaf), bootstrap=config.bootstrap, seed=config.seed,
    ).fit(rows)
    path = scratch(spark)
    model.write().save(path)
    data = spark.read.parquet(os.path.join(path, "data")).select(F.col("treeID").alias("tree_index"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    nodes = data.select(
        F.col("tree_index").cast("int"), F.col("id").cast("int").alias("node_id"), F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"), F.when(~leaf, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"), F.col("prediction"), F.col("rawCount").cast("double").alias("count"), F.when(leaf, 0.0).otherwise(F.col("gain")).alias("gain"),
    )
    return prune(nodes, config.min_samples_split).withColumn("missing_left", F.lit(None).cast("boolean"))


def prune(nodes: DataFrame, min_samples_split: int) -> DataFrame:
    """Nodes with fewer rows than ``min_samples_split`` become leaves. What hangs below is never reached."""
    small = (F.col("count") < max(2, min_samples_split)) & (F.col("feature") >= 0)
    return nodes.select("tree_index", "node_id", *[F.when(small, v).otherwise(F.col(c)).cast(t).alias(c) for c, v, t in (("feature", -1, "int"), ("threshold", None, "double"), ("left", -1, "int"), ("right", -1, "int"))], "prediction", "count", F.when(small, 0.0).otherwise(F.col("gain")).alias("gain"))


def _impurity_of(counts: list[Column], total: Column, criterion: str) -> Column:
    shares = [F.when(total > 0, c / total).otherwise(0.0) for c in counts]
    if criterion == "gini":
        return 1 - sum((s * s for s in shares[1:]), shares[0] * shares[0])
    terms = [F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares]
    return sum(terms[1:], terms[0])


def split_gains(binned: DataFrame, group_cols: list[str], criterion: str, n_classes: int | None) -> DataFrame:
    """All candidate splits (group, feature, bin, gain, counts) from rows (group, feature, bin, label, weight).

    One aggregation to (group, feature, bin), then prefix sums: nothing larger than bins times features is sorted.
    """
    key = [*group_cols, "feature"]
    if criterion == "variance":
        sums = {"w": F.col("weight"), "s": F.col("weight") * F.col("label"), "q": F.col("weight") * F.col("label") * F.col("label")}
    else:
        sums = {f"c{i}": F.when(F.col("label") == i, F.col("weight")).otherwise(0) for i in range(n_classes)}
    cells = binned.groupBy(*key, "bin").agg(*[F.sum(v).cast("double").alias(k) for k, v in sums.items()])
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    d = cells.select(*key, "bin", *[F.sum(k).over(upto).alias(f"l_{k}") for k in sums], *[F.sum(k).over(whole).alias(f"a_{k}") for k in sums])
    d = d.withColumns({f"r_{k}": F.col(f"a_{k}") - F.col(f"l_{k}") for k in sums})
    if criterion == "variance":
        n = {p: F.col(f"{p}_w") for p in "lra"}
        imp = {p: F.when(n[p] > 0, F.col(f"{p}_q") / n[p] - F.pow(F.col(f"{p}_s") / n[p], 2)).otherwise(0.0) for p in "lra"}
    else:
        n = {p: sum((F.col(f"{p}_{k}") for k in list(sums)[1:]), F.col(f"{p}_{list(sums)[0]}")) for p in "lra"}
        imp = {p: _impurity_of([F.col(f"{p}_{k}") for k in sums], n[p], criterion) for p in "lra"}
    gain = imp["a"] - (n["l"] * imp["l"] + n["r"] * imp["r"]) / n["a"]
    extra = [F.col(f"a_{k}").alias(k) for k in sums]
    return d.select(*key, "bin", F.round(gain, 9).alias("gain"), n["l"].alias("n_left"), n["r"].alias("n_right"), n["a"].alias("n"), *extra)


def best_splits(binned: DataFrame, group_cols: list[str], criterion: str, n_classes: int | None = None, min_leaf: int = 1) -> DataFrame:
    """The split of most gain of each group; of equal gains, the lower feature, then the lower bin."""
    gains = split_gains(binned, group_cols, criterion, n_classes).where((F.col("n_left") >= min_leaf) & (F.col("n_right") >= min_leaf))
    best = gains.groupBy(*group_cols).agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "bin", "n_left", "n_right", "n")).alias("b"))
    return best.select(*group_cols, F.col("b.feature").alias("feature"), F.col("b.bin").alias("bin"), (-F.col("b.g")).alias("gain"), F.col("b.n_left").alias("n_left"), F.col("b.n_right").alias("n_right"), F.col("b.n").alias("n"))


def fit_forest_sql(df: DataFrame, features: list[str], target: str, config: ForestConfig, *, n_classes: int | None, row_id: str = "row_id", bins: int | None = 32, trees: list[int] | None = None, finish: int | None = None, draws: str = "poisson") -> DataFrame:
    """Node table of a forest that is grown by aggregation alone, with missing values, exact cuts and any depth; see
    ``grow.grow_forest``. Only the trees ``trees`` of it, if given."""
    from sparkforest.operators import grow

    return grow.grow_forest(df, features, target, config, n_classes=n_classes, row_id=row_id, bins=bins, trees=trees, finish=grow.FINISH_ROWS if finish is None else finish, draws=draws)


def missing_trees(expected: DataFrame, trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected trees that aren't completed, or are claimed so without nodes."""
    done = trees.where("status = 'COMPLETED'").select("tree_index").distinct().join(nodes.select("tree_index").distinct(), "tree_index", "left_semi")
    return expected.join(done, "tree_index", "left_anti")
