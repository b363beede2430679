"""Forests grown by aggregation: level by level over all trees of all experiments, and small nodes to their end inside
one task.

Rows with a missing value are a cell of their own, which each cut tries on both sides. Cuts are quantiles of a feature
or, exactly, all its values. A node draws its features by md5 of the tree's seed and the node's path, so a forest
depends neither on the partitioning nor on where a subtree was grown. Nothing bounds the depth: nodes are numbered
level by level, without holes, and then those of finished subtrees.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.operators.grid import ForestConfig, resolve_max_features
from sparkforest.operators.split import draws as poisson_draws
from sparkforest.operators.split import exact_bootstrap, uniform

#: Rows of a node, at most, that is finished inside a task.
FINISH_ROWS = 4096
#: Quantiles by which a feature is cut.
BINS = 32
#: Levels that rows are taken down by the splits alone, before their places are written anew.
LEVELS = 4

_TREE = ["experiment", "tree_index"]
_GROUP = [*_TREE, "node_id"]
_SUBTREE = "experiment int, tree_index int, root_id int, local int, feature int, threshold double, left int, right int, prediction double, count double, gain double, missing_left boolean"


@dataclass(frozen=True)
class Rules:
    """What decides a split, here and in the tasks. Over the levels of a grid, ``min_leaf`` and ``entropy`` (whether the
    impurity is that, and not ``criterion``) are columns of the experiment."""

    criterion: str
    n_classes: int | None
    n_features: int
    k: int
    min_split: int
    min_leaf: int | F.Column
    midpoints: bool
    entropy: F.Column | None = None


def present(column) -> F.Column:
    """A number; null where it is missing, which NaN counts as."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def cell_sums(rules: Rules) -> dict:
    weight, label = F.col("weight"), F.col("label")
    if rules.criterion == "variance":
        return {"w": weight, "s": weight * label, "q": weight * label * label}
    return {f"c{i}": F.when(label == i, weight).otherwise(0) for i in range(rules.n_classes)}


def prefix_sums(cells: DataFrame, key: list[str], sums: list[str], ranged: bool, store=None) -> DataFrame:
    """Cells (key, value, sums) with a known value, and of their key the sums up to them (``l_``), of all cells (``a_``) and
    of those without a value (``m_``), and the next value (``next``).

    ``ranged``: values are too many for a task. Cells are then range-sorted once and stored; a range has sums of its own,
    and what stands before it comes from one row for each key and range.
    """
    known = F.col("value").isNotNull()
    if not ranged:
        upto, whole = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
        found = {"next": F.lead("value").over(Window.partitionBy(*key).orderBy("value"))}
        for k in sums:
            found |= {f"l_{k}": F.sum(F.when(known, F.col(k)).otherwise(0.0)).over(upto), f"a_{k}": F.sum(k).over(whole), f"m_{k}": F.sum(F.when(known, 0.0).otherwise(F.col(k))).over(whole)}
        return cells.select(*key, "value", *[v.alias(c) for c, v in found.items()]).where(known)
    cells = store(cells.repartitionByRange(*key, "value").withColumn("_p", F.spark_partition_id()))
    parts = cells.groupBy(*key, "_p").agg(F.min("value").alias("_first"), *[F.sum(F.when(known, F.col(k)).otherwise(0.0)).alias(f"s_{k}") for k in sums], *[F.sum(F.when(known, 0.0).otherwise(F.col(k))).alias(f"n_{k}") for k in sums])
    by, whole = Window.partitionBy(*key).orderBy("_p"), Window.partitionBy(*key)  # a row for each range
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    offsets = parts.select(*key, "_p", F.min("_first").over(after).alias("_after"), *[F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0.0)).alias(f"b_{k}") for k in sums], *[F.sum(f"n_{k}").over(whole).alias(f"m_{k}") for k in sums], *[(F.sum(f"s_{k}").over(whole) + F.sum(f"n_{k}").over(whole)).alias(f"a_{k}") for k in sums])
    inside = Window.partitionBy(*key, "_p").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = cells.where(known).select(*key, "value", "_p", F.lead("value").over(inside).alias("_next"), *[F.sum(k).over(upto).alias(f"u_{k}") for k in sums])
    return local.join(offsets, [*key, "_p"]).select(*key, "value", F.coalesce("_next", "_after").alias("next"), *[(F.col(f"u_{k}") + F.col(f"b_{k}")).alias(f"l_{k}") for k in sums], *[f"a_{k}" for k in sums], *[f"m_{k}" for k in sums])


def splits_of(rows: DataFrame, group: list[str], rules: Rules, ranged: bool = False, store=None) -> DataFrame:
    """The best split of each group, from rows (group, feature, value, label, weight) whose value may be null.

    (group, feature, threshold, missing_left, gain, n_left, n_right, n): rows up to the threshold go left, those without a
    value where ``missing_left`` says. Of equal gains: the lower feature, then the lower value, then missing to the right.
    A group without missing values in the feature sends them to its larger side. A threshold of infinity parts what is
    missing from all else.
    """
    from sparkforest.operators.train import _impurity_of

    key, sums = [*group, "feature"], cell_sums(rules)
    cells = rows.groupBy(*key, "value").agg(*[F.sum(v).cast("double").alias(k) for k, v in sums.items()])
    d = prefix_sums(cells, key, list(sums), ranged, store)
    names = list(sums) if rules.criterion != "variance" else ["w"]
    total = lambda p: sum((F.col(f"{p}_{k}") for k in names[1:]), F.col(f"{p}_{names[0]}"))
    sides = F.when(total("m") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    d = d.select("*", (total("m") > 0).alias("_some"), F.explode(sides).alias("_left"))
    d = d.withColumns({f"l_{k}": F.col(f"l_{k}") + F.when(F.col("_left"), F.col(f"m_{k}")).otherwise(0.0) for k in sums})
    d = d.withColumns({f"r_{k}": F.col(f"a_{k}") - F.col(f"l_{k}") for k in sums})
    n = {p: total(p) for p in "lra"}
    if rules.criterion == "variance":
        imp = {p: F.when(n[p] > 0, F.col(f"{p}_q") / n[p] - F.pow(F.col(f"{p}_s") / n[p], 2)).otherwise(0.0) for p in "lra"}
    else:
        of = lambda p, criterion: _impurity_of([F.col(f"{p}_{k}") for k in sums], n[p], criterion)
        imp = {p: of(p, rules.criterion) if rules.entropy is None else F.when(rules.entropy, of(p, "entropy")).otherwise(of(p, rules.criterion)) for p in "lra"}
    gain = F.round(imp["a"] - (n["l"] * imp["l"] + n["r"] * imp["r"]) / n["a"], 9)
    fits = (n["l"] >= rules.min_leaf) & (n["r"] >= rules.min_leaf)
    d = d.where(fits).select(*key, "value", "next", "_left", "_some", gain.alias("gain"), n["l"].alias("n_left"), n["r"].alias("n_right"), n["a"].alias("n"))
    best = d.groupBy(*group).agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "value", "_left", "_some", "next", "n_left", "n_right", "n")).alias("b"))
    middle = (F.col("b.value") + F.col("b.next")) / 2
    cut = F.when(F.col("b.next").isNull(), F.lit(float("inf"))).when((middle > F.col("b.value")) & (middle < F.col("b.next")), middle).otherwise(F.col("b.value"))
    threshold = cut if rules.midpoints else F.col("b.value")
    left = F.when(F.col("b._some"), F.col("b._left")).otherwise(F.col("b.n_left") >= F.col("b.n_right"))
    return best.select(*group, F.col("b.feature").alias("feature"), threshold.alias("threshold"), left.alias("missing_left"), (-F.col("b.g")).alias("gain"), *[F.col(f"b.{c}").alias(c) for c in ("n_left", "n_right", "n")])


# ---- inside a task


def _drawn(seed: int, path: str, rules: Rules) -> list[int]:
    if rules.k == rules.n_features:
        return list(range(rules.k))
    u = [(int(hashlib.md5(f"{seed}:{path}/{i}".encode()).hexdigest()[:8], 16) / 2**32, i) for i in range(rules.n_features)]
    return sorted(i for _, i in sorted(u)[: rules.k])


def _child(path: str, side: str) -> str:
    return hashlib.md5(f"{path}{side}".encode()).hexdigest()[:16]


def _impurity(parts: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(rows, impurity) of the sums in the last axis, step by step as the expressions over cells."""
    if rules.criterion == "variance":
        n = parts[..., 0]
        safe = np.where(n > 0, n, 1.0)
        return n, np.where(n > 0, parts[..., 2] / safe - (parts[..., 1] / safe) ** 2, 0.0)
    n = parts.sum(axis=-1)
    shares = np.where(n[..., None] > 0, parts / np.where(n > 0, n, 1.0)[..., None], 0.0)
    total = np.zeros(n.shape)
    for i in range(parts.shape[-1]):
        s = shares[..., i]
        total = total + (s * s if rules.criterion == "gini" else np.where(s > 0, -s * np.log2(np.where(s > 0, s, 1.0)), 0.0))
    return n, 1 - total if rules.criterion == "gini" else total


def _best(x: np.ndarray, sums: np.ndarray, drawn: list[int], rules: Rules) -> tuple | None:
    """(gain, feature, threshold, missing_left) of rows x with their sums, by the order that ``splits_of`` has."""
    total, found = sums.sum(axis=0), None
    n, whole = _impurity(total, rules)
    for f in drawn:
        v = x[:, f]
        lacks = np.isnan(v)
        order = np.argsort(v[~lacks], kind="stable")
        if not len(order):
            continue
        value, upto = v[~lacks][order], np.cumsum(sums[~lacks][order], axis=0)
        last = np.flatnonzero(np.append(value[1:] != value[:-1], True))
        value, upto = value[last], upto[last]
        missing = sums[lacks].sum(axis=0)
        some = bool(lacks.any())
        left = np.stack([upto, upto + missing], axis=1) if some else upto[:, None]
        n_left, left_imp = _impurity(left, rules)
        n_right, right_imp = _impurity(total - left, rules)
        gain = np.round(whole - (n_left * left_imp + n_right * right_imp) / n, 9)
        gain = np.where((n_left >= rules.min_leaf) & (n_right >= rules.min_leaf), gain, -np.inf)
        at, side = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[at, side] > (found[0] if found else 0):
            cut = value[at]
            if rules.midpoints:
                middle = (value[at] + value[at + 1]) / 2 if at + 1 < len(value) else np.inf
                cut = middle if at + 1 == len(value) or value[at] < middle < value[at + 1] else value[at]
            found = float(gain[at, side]), f, float(cut), bool(side) if some else bool(n_left[at, side] >= n_right[at, side])
    return found


def subtree(x: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int, path: str, rules: Rules, depth: int | None) -> list[tuple]:
    """Nodes (local, feature, threshold, left, right, prediction, count, gain, missing_left) below a node, itself being 0.
    ``depth``: levels that are left, or None."""
    if rules.criterion == "variance":
        sums = np.stack([weight, weight * label, weight * label * label], axis=1).astype(float)
    else:
        sums = np.zeros((len(label), rules.n_classes))
        sums[np.arange(len(label)), label.astype(int)] = weight
    out, todo, used = [], [(0, np.arange(len(label)), path, depth)], 1
    while todo:
        local, rows, at, left = todo.pop()
        own = sums[rows]
        total = own.sum(axis=0)
        n = float(total[0] if rules.criterion == "variance" else total.sum())
        prediction = float(total[1] / total[0] if rules.criterion == "variance" else total.argmax())
        best = _best(x[rows], own, _drawn(seed, at, rules), rules) if left != 0 and n >= rules.min_split else None
        if best is None:
            out.append((local, -1, None, -1, -1, prediction, n, 0.0, None))
            continue
        gain, feature, threshold, missing_left = best
        v = x[rows, feature]
        go = np.where(np.isnan(v), missing_left, v <= threshold)
        out.append((local, feature, threshold, used, used + 1, prediction, n, gain, missing_left))
        todo += [(used + i, rows[go == side], _child(at, "LR"[i]), None if left is None else left - 1) for i, side in ((0, True), (1, False))]
        used += 2
    return out


# ---- the forest


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    return [sorted({float(t) for t in c}) for c in df.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001)]


def grow_forest(df: DataFrame, features: list[str], target: str, config: ForestConfig, *, n_classes: int | None, row_id: str = "row_id", bins: int | None = BINS, trees: list[int] | None = None, finish: int = FINISH_ROWS, draws: str = "poisson") -> DataFrame:
    """Node table of a forest, or of the trees ``trees`` of it: each tree is the same whichever others are grown. See
    ``grow_grid``, of which this is a grid of one."""
    return grow_grid(df, features, target, [config], n_classes=n_classes, row_id=row_id, bins=bins, trees=[trees], finish=finish, draws=draws).drop("experiment")


def grow_grid(df: DataFrame, features: list[str], target: str, configs: list[ForestConfig], *, n_classes: int | None, row_id: str = "row_id", bins: int | None = BINS, trees: list[list[int] | None] | None = None, finish: int = FINISH_ROWS, draws: str = "poisson") -> DataFrame:
    """Node table of the forests of all experiments, ``experiment`` being an index of ``configs``: each tree is the same
    whichever others are grown. ``trees``: for each experiment, the indexes of its trees to grow, or None for all.

    A row is held once, with the list of its places (tree, weight), so a level is the same few passes over the rows for any
    number of experiments. A pass takes each place down from where it was written last by the splits of the levels since,
    which are small tables; only every LEVELS levels, places (experiment, tree, weight, node) are shuffled and written anew.
    Their samples are drawn once: seed, bootstrap and criterion's kind are one's own.

    ``bins``: quantiles that cut a feature, rows then hold the number of their cut; None: every value is a cut, at the middle
    to the next value of the node. Missing values (null, NaN) go to the better side of each split. ``n_classes`` None:
    regression; labels are indexes 0 to n_classes - 1. ``draws``: how often a row is in a tree's sample, ``poisson`` for each
    row by itself, with n in all on average, or ``exact``, n in all. Nodes of up to ``finish`` rows grow to their end in a
    task; the forest is the same with any number. No rows give no nodes.
    """
    from sparkforest.operators.train import NODES, impurity, stored

    if len({(c.seed, c.bootstrap) for c in configs}) > 1:
        raise ValueError("experiments of a grid share their seed and whether samples are drawn")
    kinds = [impurity(c, n_classes is not None) for c in configs]
    each = [Rules(kind, n_classes, len(features), resolve_max_features(c.max_features, len(features)), max(2, c.min_samples_split), max(1, c.min_samples_leaf), bins is None) for kind, c in zip(kinds, configs)]
    of = lambda values: F.element_at(F.lit(values), F.col("experiment") + 1)
    one, limits = each[0], [-1 if c.max_depth is None else c.max_depth for c in configs]
    together = Rules("variance" if n_classes is None else "gini", n_classes, len(features), one.k, one.min_split, of([r.min_leaf for r in each]), bins is None, None if n_classes is None else of([k == "entropy" for k in kinds]))
    wanted = [(e, t) for e, c in enumerate(configs) for t in (range(c.n_estimators) if not trees or trees[e] is None else trees[e])]
    spark, seed, bootstrap = df.sparkSession, configs[0].seed, configs[0].bootstrap

    names = [f"_x{i}" for i in range(len(features))]
    own = df.select(F.col(row_id).alias("_id"), F.col(target).cast("double").alias("label"), *[present(F.col(f"`{f}`")).alias(x) for x, f in zip(names, features)])
    values, cuts = [F.col(x) for x in names], None
    if bins is not None:  # a value becomes the number of the cut at or above it; past the last, infinity is the cut
        own = stored(own)
        cuts = [[*c, float("inf")] for c in quantile_cuts(own, names, bins)]
        number = lambda v, c: F.size(F.filter(F.lit(c), lambda t: t < v)) if len(c) > 1 else F.lit(0)
        values = [F.when(v.isNotNull(), number(v, c)).cast("short") for v, c in zip(values, cuts)]
    rows = own.select(F.monotonically_increasing_id().alias("row"), "_id", "label", F.array(*values).alias("x"))
    drawn_trees, most = sorted({t for _, t in wanted}), max(c.n_estimators for c in configs)
    if draws == "exact" and bootstrap:
        rows = stored(rows)
        drawn = exact_bootstrap(rows.select("row", "_id"), "_id", most, seed, drawn_trees)
        drawn = drawn.groupBy("row").agg(F.collect_list(F.struct("tree_index", "weight")).alias("places"))
        rows = stored(rows.drop("_id").join(drawn, "row"))
    else:  # a row's own uniforms decide, so nothing moves
        us = F.transform(F.lit(drawn_trees), lambda t: uniform(F.lit(seed) + t, F.col("_id")) if bootstrap else F.lit(1.0))
        place = lambda u, i: F.struct(F.element_at(F.lit(drawn_trees), i + 1).alias("tree_index"), (poisson_draws(u) if bootstrap else F.lit(1)).alias("weight"))
        places = F.filter(F.transform("_us", place), lambda p: p["weight"] > 0)
        rows = stored(rows.withColumn("_us", us).select("row", "label", "x", places.alias("places")))
    pairs = spark.createDataFrame(wanted, "experiment int, tree_index int")
    flat = rows.select("row", "label", "x", F.inline("places")).join(F.broadcast(pairs), "tree_index").withColumn("node_id", F.lit(1))
    live = pairs.withColumns({"node_id": F.lit(1), "path": F.lit("1")})
    depth, level, done = 0, [], []
    used: dict[tuple[int, int], int] = {}
    while True:
        classes = [F.sum(F.when(F.col("label") == i, F.col("weight")).otherwise(0)).alias(f"c{i}") for i in range(n_classes or 0)]
        mean = [] if n_classes else [(F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("prediction")]
        stat = flat.groupBy(*_GROUP).agg(F.sum("weight").cast("double").alias("n"), F.count("*").alias("rows"), *classes, *mean)
        if n_classes:  # the most frequent class; of equal counts, the lowest
            counts = F.array(*[f"c{i}" for i in range(n_classes)])
            stat = stat.withColumn("prediction", (F.array_position(counts, F.array_max(counts)) - 1).cast("double"))
        stat = stored(stat.join(live, _GROUP).select(*_GROUP, "path", "n", "rows", "prediction"))
        if not used:
            used = {(r["experiment"], r["tree_index"]): 1 for r in stat.select(*_TREE).collect()}
        small, large = stat.where(F.col("rows") <= finish), stat.where(F.col("rows") > finish)
        many = stat.agg(F.count(F.when(F.col("rows") <= finish, 1)), F.count(F.when(F.col("rows") > finish, 1))).first()
        if many[0]:
            done.append(stored(_finished(flat.join(small.select(*_GROUP, "path"), _GROUP), each, [None if limit < 0 else limit - depth for limit in limits], seed, cuts)))
        if not many[1]:
            break
        # What a node looks at: the features of its lots, in as many as its experiment has.
        lots = F.array(*[F.struct(uniform(F.lit(seed) + F.col("tree_index"), F.concat_ws("/", "path", F.lit(i))).alias("u"), F.lit(i).alias("feature")) for i in range(len(features))])
        chosen = F.slice(F.array_sort(lots), F.lit(1), of([r.k for r in each])) if min(r.k for r in each) < len(features) else lots
        open_ = large.where(F.col("n") >= of([r.min_split for r in each])).where(of(limits) != depth)
        looks = open_.select(*_GROUP, F.transform(chosen, lambda x: x["feature"]).alias("looks"))
        parts = flat.join(looks, _GROUP).select(*_GROUP, "label", "weight", "x", F.explode("looks").alias("feature"))
        parts = parts.select(*_GROUP, "feature", F.element_at("x", F.col("feature") + 1).cast("double").alias("value"), "label", "weight")
        best = splits_of(parts, _GROUP, together, bins is None, stored).where("gain > 0").drop("n", "n_left", "n_right")
        # Children are numbered in the order of their parents, past all nodes that the tree has so far.
        base = spark.createDataFrame([(*k, n) for k, n in sorted(used.items())], "experiment int, tree_index int, base int")
        child = F.col("base") + 2 * F.row_number().over(Window.partitionBy(*_TREE).orderBy("node_id")) - 1
        best = best.join(base, _TREE).withColumn("child", child.cast("int")).drop("base")
        if cuts is not None:
            table = spark.createDataFrame([(f, float(i), t) for f, c in enumerate(cuts) for i, t in enumerate(c)], "feature int, at double, cut double")
            best = best.withColumnRenamed("threshold", "at").join(table, ["feature", "at"]).withColumnRenamed("cut", "threshold")
        else:
            best = best.withColumn("at", F.col("threshold"))
        best = stored(best)
        split = best.groupBy(*_TREE).count().collect()
        for r in split:
            used[r["experiment"], r["tree_index"]] += 2 * r["count"]
        level.append(_nodes(large.join(best, _GROUP, "left")))
        if not split:
            break
        value = F.element_at("x", F.col("feature") + 1).cast("double")
        left = F.when(value.isNull(), F.col("missing_left")).otherwise(value <= F.col("at"))
        gone = flat.join(best.select(*_GROUP, "feature", "at", "missing_left", "child"), _GROUP)
        flat = gone.select("row", "label", "x", *_TREE, "weight", F.when(left, F.col("child")).otherwise(F.col("child") + 1).alias("node_id"))
        ways = F.explode(F.array(*[F.struct((F.col("child") + i).alias("node_id"), F.substring(F.md5(F.concat("path", F.lit(side))), 1, 16).alias("path")) for i, side in enumerate("LR")])).alias("w")
        live = best.join(stat.select(*_GROUP, "path"), _GROUP).select(*_TREE, ways).select(*_TREE, "w.*")
        depth += 1
        if depth % LEVELS == 0:
            places = flat.groupBy("row").agg(F.collect_list(F.struct(*_TREE, "weight", "node_id")).alias("places"))
            flat = stored(rows.drop("places").join(places, "row")).select("row", "label", "x", F.inline("places"))
    nodes = spark.createDataFrame([], f"experiment int, {NODES}, missing_left boolean")
    for x in [*level, *([_placed(spark, done, used)] if done else [])]:
        nodes = nodes.unionByName(x)
    return nodes.select("experiment", *[F.col(c.split()[0]).cast(c.split()[1]) for c in NODES.split(", ")], "missing_left")


def _nodes(level: DataFrame) -> DataFrame:
    has = F.col("threshold").isNotNull()
    part = lambda v, other: F.when(has, v).otherwise(other)
    return level.select(*_GROUP, part(F.col("feature"), -1).alias("feature"), "threshold", part(F.col("child"), -1).alias("left"), part(F.col("child") + 1, -1).alias("right"), "prediction", F.col("n").alias("count"), part(F.col("gain"), 0.0).alias("gain"), "missing_left")


def _finished(rows: DataFrame, rules: list[Rules], depths: list[int | None], seed: int, cuts: list[list[float]] | None) -> DataFrame:
    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        e, tree = int(key[0]), int(key[1])
        x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]).reshape(len(pdf), rules[e].n_features)
        nodes = subtree(x, pdf["label"].to_numpy(float), pdf["weight"].to_numpy(float), seed + tree, pdf["path"].iloc[0], rules[e], depths[e])
        out = pd.DataFrame(nodes, columns=["local", "feature", "threshold", "left", "right", "prediction", "count", "gain", "missing_left"])
        if cuts is not None:
            out["threshold"] = [None if f < 0 else cuts[f][int(t)] for f, t in zip(out["feature"], out["threshold"])]
        out["missing_left"] = out["missing_left"].astype(object)
        return out.assign(experiment=e, tree_index=tree, root_id=int(key[2]))[[c.split()[0] for c in _SUBTREE.split(", ")]]

    return rows.groupBy(*_GROUP).applyInPandas(grow, _SUBTREE)


def _placed(spark, done: list[DataFrame], used: dict[tuple[int, int], int]) -> DataFrame:
    """Nodes of finished subtrees with their numbers in the tree: roots have theirs, the rest follow root by root."""
    all_of = done[0]
    for x in done[1:]:
        all_of = all_of.unionByName(x)
    sizes = all_of.groupBy(*_TREE, "root_id").agg((F.count("*") - 1).alias("more"))
    before = Window.partitionBy(*_TREE).orderBy("root_id").rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame([(*k, n) for k, n in sorted(used.items())], "experiment int, tree_index int, base int")
    offsets = sizes.join(base, _TREE).select(*_TREE, "root_id", (F.col("base") + F.coalesce(F.sum("more").over(before), F.lit(0))).alias("_o"))
    number = lambda c: F.when(F.col(c) == 0, F.col("root_id")).when(F.col(c) < 0, -1).otherwise(F.col("_o") + F.col(c))
    placed = all_of.join(offsets, [*_TREE, "root_id"])
    return placed.select(*_TREE, number("local").alias("node_id"), "feature", "threshold", number("left").alias("left"), number("right").alias("right"), "prediction", "count", "gain", "missing_left")
