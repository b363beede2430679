"""Scoring with node tables: each tree's prediction, hard votes, means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_case(rows: list[dict], features: list[str]) -> Column:
    """One tree as a CASE expression; for shallow trees, since deep ones outgrow compiled methods."""
    by_id = {r["node_id"]: r for r in rows}

    def at(i: int) -> Column:
        r = by_id[i]
        if r["feature"] < 0:
            return F.lit(float(r["prediction"]))
        x = F.col(f"`{features[r['feature']]}`").cast("double")
        left = F.when(x.isNull() | F.isnan(x), F.lit(bool(r.get("missing_left")))).otherwise(x <= r["threshold"])
        return F.when(left, at(r["left"])).otherwise(at(r["right"]))

    return at(min(by_id))


def forest_arrays(nodes: DataFrame) -> list[dict]:
    """The forest on the driver, as the scorer takes it. Its size is the model's, not the data's."""
    pdf = nodes.toPandas()
    out = []
    for t, g in sorted(pdf.groupby("tree_index")):
        g = g.sort_values("node_id")
        ids = g["node_id"].to_numpy()
        child = lambda c: np.searchsorted(ids, g[c].to_numpy())  # noqa: B023, E731
        out.append({"tree": int(t), "feature": g["feature"].to_numpy(), "threshold": g["threshold"].to_numpy(float), "left": child("left"), "right": child("right"), "prediction": g["prediction"].to_numpy(float)})
        sides = g["missing_left"].to_numpy(object) if "missing_left" in g else np.zeros(len(g), object)
        out[-1]["missing_left"] = np.array([bool(x) if x is not None and x == x else False for x in sides])
    return out


def predict_trees(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``tree_predictions``, one value for each tree in the order of indexes. Rows stay where they are.

    Trees go to the tasks in groups of at most GROUP_NODES nodes (or one tree), so that a task holds a bounded part
    of a large forest at a time.
    """
    sizes = nodes.groupBy("tree_index").agg(F.count("*").alias("n")).orderBy("tree_index").collect()
    if not sizes:
        raise ValueError("the model has no trees")
    groups: list[list[int]] = []
    held = GROUP_NODES
    for r in sizes:
        if held + r["n"] > GROUP_NODES:
            groups.append([])
            held = 0
        groups[-1].append(r["tree_index"])
        held += r["n"]
    parts = [_predict_group(df, nodes.where(F.col("tree_index").isin(g)) if len(groups) > 1 else nodes, features) for g in groups]
    return df.withColumn("tree_predictions", F.concat(*parts) if len(parts) > 1 else parts[0])


#: Nodes of a group of trees (about 40 bytes each).
GROUP_NODES = 2_000_000


def _predict_group(df: DataFrame, nodes: DataFrame, features: list[str]) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(forest_arrays(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        forest = shared.value
        for b in batches:
            x = b.to_numpy(float)
            out = np.empty((len(x), len(forest)))
            n = np.arange(len(x))
            for j, t in enumerate(forest):
                at = np.zeros(len(x), np.int64)
                while (inner := t["feature"][at] >= 0).any():
                    v = x[n[inner], t["feature"][at[inner]]]
                    go = np.where(np.isnan(v), t["missing_left"][at[inner]], v <= t["threshold"][at[inner]])
                    at[inner] = np.where(go, t["left"][at[inner]], t["right"][at[inner]])
                out[:, j] = t["prediction"][at]
            yield pd.Series(list(out), dtype=object)

    return F.pandas_udf(run, "array<double>")(F.struct(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(features)]))


#: Nodes of a level, at most, that go to all tasks (about 80 bytes each); more are joined by shuffle.
LEVEL_NODES = 50_000
#: Levels that are gone down between two writes.
LEVELS = 4


def descend(at: DataFrame, nodes: DataFrame, tree: list[str]) -> DataFrame:
    """(columns of ``at``, prediction): where each row (``tree`` columns, ``x``: an array of its features) ends.

    Level by level: rows meet the nodes of their level by (tree, node id), a level's few nodes in all tasks, and its many by
    shuffle, when no node has many rows any more. The driver holds no nodes, so a forest may be of any size and depth. A row
    whose tree has no nodes gets no prediction and is left out.
    """
    from sparkforest.operators.train import stored

    keys, names = [*tree, "_node"], at.columns
    known = nodes if "missing_left" in nodes.columns else nodes.withColumn("missing_left", F.lit(None).cast("boolean"))
    known = known.select(*tree, F.col("node_id").alias("_node"), F.col("feature").alias("_f"), F.col("threshold").alias("_t"), F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("prediction").alias("_p"), F.coalesce("missing_left", F.lit(False)).alias("_m"))
    roots = stored(known.groupBy(*tree).agg(F.min("_node").alias("_node")))
    at = at.join(roots, tree).withColumn("prediction", F.lit(None).cast("double"))
    level, done = roots, []
    while True:
        shuffled = False
        for _ in range(LEVELS):
            here = stored(known.join(level, keys))
            n = here.count()
            level = here.where("_f >= 0").select(*tree, F.explode(F.array("_l", "_r")).alias("_node"))
            if not n:
                break
            shuffled = n > LEVEL_NODES
            met = at.join(here if shuffled else F.broadcast(here), keys, "left")
            v = F.element_at("x", F.col("_f") + 1)
            left = F.when(v.isNull() | F.isnan(v), F.col("_m")).otherwise(v <= F.col("_t"))
            ends = F.coalesce("prediction", F.when(F.col("_f") < 0, F.col("_p")))
            at = met.select(*names, F.when(F.col("_f") >= 0, F.when(left, F.col("_l")).otherwise(F.col("_r"))).alias("_node"), ends.alias("prediction"))
            if shuffled:
                break
        at = stored(at)
        done.append(at.where("prediction is not null").select(*names, "prediction"))
        at = at.where("prediction is null and _node is not null")
        if not n or at.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def predict_trees_by_joins(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """As ``predict_trees``, with the forest as a table that is never gathered: the driver has the trees' indexes alone.
    Rows are stored with a number first, so repeated ones stay apart."""
    from sparkforest.operators.split import _free
    from sparkforest.operators.train import stored

    row = _free("_row", df.columns)
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()))
    trees = sorted(r[0] for r in nodes.select("tree_index").distinct().collect())
    if not trees:
        raise ValueError("the model has no trees")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x")
    ends = descend(numbered.select(F.col(row).alias("_id"), x, F.explode(F.lit(trees)).alias("tree_index")), nodes, ["tree_index"])
    made = ends.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("tree_index", "prediction"))).alias("_p"))
    made = made.select("_id", F.transform("_p", lambda p: p["prediction"]).alias("tree_predictions"))
    return numbered.join(made, numbered[row] == made["_id"]).drop(row, "_id")


def votes(tree_predictions: Column, n_classes: int) -> Column:
    """How many trees say each class."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.size(F.filter(tree_predictions, lambda p: p == k)))


def vote(df: DataFrame, labels: list[str], predictions: str = "tree_predictions") -> DataFrame:
    """Adds ``votes`` and ``prediction``: the class with most votes; of equal votes, the lowest index."""
    v = df.withColumn("votes", votes(F.col(predictions), len(labels)))
    return v.withColumn("prediction", F.element_at(F.lit(labels), F.array_position("votes", F.array_max("votes")).cast("int")))


def mean_prediction(df: DataFrame, predictions: str = "tree_predictions") -> DataFrame:
    return df.withColumn("prediction", F.aggregate(predictions, F.lit(0.0), lambda a, x: a + x) / F.size(predictions))


def long_votes(tree_rows: DataFrame, row_id: str = "row_id", label: str = "label_idx", n_classes: int | None = None) -> DataFrame:
    """Votes from rows (row, tree, class); partial votes of shards add up by the same sum. With ``n_classes``, a class that
    isn't 0 to n_classes - 1 is an error."""
    if n_classes is not None:
        known = F.col(label).between(0, n_classes - 1)
        tree_rows = tree_rows.withColumn(label, F.when(known, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("no class "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast(tree_rows.schema[label].dataType)))
    return tree_rows.groupBy(row_id, label).agg(F.count("*").alias("n"))


def winner(vote_rows: DataFrame, row_id: str = "row_id", label: str = "label_idx", n: str = "n") -> DataFrame:
    """(row, class, votes) of the class with most votes; of equal votes, the lowest index."""
    total = vote_rows.groupBy(row_id, label).agg(F.sum(n).alias("n"))
    best = total.groupBy(row_id).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("b"))
    return best.select(row_id, F.col("b.l").alias(label), (-F.col("b.n")).alias("n"))


def predict(df: DataFrame, nodes: DataFrame, features: list[str], labels: list[str] | None) -> DataFrame:
    """Batch inference: adds ``prediction`` (a label, or a mean where ``labels`` is None) and the votes."""
    from sparkforest.operators.scenario import missing_columns

    if gone := missing_columns(df, features):
        raise ValueError(f"missing features: {gone}")
    scored = predict_trees(df, nodes, features)
    return vote(scored, labels) if labels is not None else mean_prediction(scored)


def head_accuracy(df: DataFrame, n: int, row_id: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    first = df.orderBy(row_id).limit(n)
    return first.agg(F.count("*").alias("n"), F.avg(F.when(F.col(label).cast("string") == F.col(prediction).cast("string"), 1.0).otherwise(0.0)).alias("accuracy"))
