"""Deterministic splits, sampling weights and shards, by md5 of seed and row id: the same on any partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distribution of the number of draws of a row, Poisson with mean 1, as far as a 32-bit uniform tells.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def uniform(seed, row_id: Column) -> Column:
    """0 to 1, from 32 bits of md5('seed:id')."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), row_id.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def assign_splits(df: DataFrame, *, validation_ratio: float, test_ratio: float, seed: int, row_id: str, target: str | None = None, task_type: str = "regression", exact: bool = False) -> DataFrame:
    """Adds ``split``. Hash mode: thresholds on the row's uniform, one pass, no shuffle. Exact mode: sizes of each
    class (classification, where stratifying is possible) or of all rows are exact."""
    from sparkforest.operators.validate import check_ratios

    check_ratios(validation_ratio, test_ratio)
    u = uniform(seed, F.col(row_id))
    if not exact:
        return df.withColumn("split", F.when(u < test_ratio, "test").when(u < test_ratio + validation_ratio, "validation").otherwise("train"))
    h, t, v = (_free(c, df.columns) for c in ("_h", "_test", "_validation"))
    by_class = F.col(target).cast("string") if target and task_type == "classification" else None
    marked = df.withColumn(h, (u * 4294967296.0).cast("long"))
    test_by = by_class if by_class is not None and stratify_eligibility(df, target, test_ratio).first()["eligible"] else F.lit("all")
    marked = _first_share(marked, F.lit(True), test_by, h, test_ratio, row_id, t)
    rest, share = ~F.col(t), validation_ratio / (1 - test_ratio)
    # The second stage has a rule of its own: what is left of each class may be too little.
    val_by = by_class if by_class is not None and stratify_eligibility(marked.where(rest), target, share).first()["eligible"] else F.lit("all")
    marked = _first_share(marked, rest, val_by, h, share, row_id, v)
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(t), "test").when(F.col(v), "validation").otherwise("train").alias("split"))


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def share_cuts(rows: DataFrame, share: float) -> DataFrame:
    """(stratum, cut, k, n) from rows (stratum, h), h of 32 bits: the first ``share`` of a stratum's rows (rounded up) by h
    are those below ``cut`` and ``k`` of the ``n`` at it. A stratum of whose rows none are taken has no row.

    Two counting passes, by the upper and then the lower 16 bits: nothing but counts is shuffled, at most 65,536 of a
    stratum, and no row is ranked.
    """
    from sparkforest.operators.train import stored

    def crossing(counts: DataFrame, by: str, k) -> DataFrame:
        """The cell of each stratum in which its k-th row lies, and k without the rows of the cells before."""
        upto = F.sum("n").over(Window.partitionBy("stratum").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        d = counts.withColumn("k", k).withColumn("upto", upto)
        return d.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).withColumn("k", F.col("k") - F.col("upto") + F.col("n")).drop("upto")

    high = rows.groupBy("stratum", F.shiftright("h", 16).alias("high")).agg(F.count("*").alias("n"))
    asked = F.ceil(F.sum("n").over(Window.partitionBy("stratum")) * F.lit(share) - 1e-9)
    cells = crossing(high, "high", asked).select(F.col("stratum").alias("_s"), F.col("high").alias("_g"), F.col("k").alias("_k"))
    # A row for each class, stored, by whose size Spark chooses the join.
    inside = rows.join(stored(cells), F.col("stratum").eqNullSafe(F.col("_s")) & (F.shiftright("h", 16) == F.col("_g")))
    low = inside.groupBy("stratum", F.col("h").alias("cut")).agg(F.count("*").alias("n"), F.first("_k").alias("_k"))
    return stored(crossing(low, "cut", F.col("_k")).select("stratum", "cut", "k", "n"))


def _first_share(df: DataFrame, among, strata: Column, h: str, share: float, row_id: str, flag: str) -> DataFrame:
    """Adds ``flag``: whether a row is one of ``among`` and in the first ``share`` of their stratum by ``h``, and by the row
    id where the cut goes through rows of one ``h``. Only such rows are ranked."""
    s, cut, k = (_free(c, df.columns) for c in ("_s", "_cut", "_k"))
    cuts = share_cuts(df.where(among).select(strata.alias("stratum"), F.col(h).alias("h")), share)
    apart = not cuts.where("k < n").isEmpty()
    cuts = cuts.select(F.col("stratum").alias(s), F.col("cut").alias(cut), F.col("k").alias(k))
    joined = df.join(cuts, strata.eqNullSafe(F.col(s)), "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = joined.select(*names, (among & F.coalesce((F.col(h) < F.col(cut)) | ((F.col(h) == F.col(cut)) & F.lit(not apart)), F.lit(False))).alias(flag))
    if not apart:
        return whole
    tied = among & F.coalesce(F.col(h) == F.col(cut), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(s).orderBy(row_id))
    at = joined.where(tied).select(*names, (rank <= F.col(k)).alias(flag))
    rest = joined.where(~tied).select(*names, (among & F.coalesce(F.col(h) < F.col(cut), F.lit(False))).alias(flag))
    return rest.unionByName(at)


def stratify_eligibility(df: DataFrame, target: str, ratio: float) -> DataFrame:
    """Whether both sides of a split can have all classes."""
    c = df.groupBy(F.col(target).cast("string").alias("_l")).agg(F.count("*").alias("n"))
    side = F.round(F.sum("n") * ratio)
    ok = (F.count("*") >= 2) & (F.min("n") >= 2) & (side >= F.count("*")) & (F.sum("n") - side >= F.count("*"))
    return c.agg(F.count("*").alias("n_classes"), F.min("n").alias("smallest"), F.sum("n").alias("n_rows"), F.coalesce(ok, F.lit(False)).alias("eligible"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def draws(u: Column) -> Column:
    """How often a row is drawn in a bootstrap sample, from its uniform."""
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(u >= _POISSON[0], 1).otherwise(0))


def bootstrap_weights(df: DataFrame, row_id: str, n_trees: int, seed: int, bootstrap: bool = True, only: list[int] | None = None) -> DataFrame:
    """A row for each row and tree (of the trees ``only``, if given): ``tree_index``, ``tree_seed`` = seed + index, ``weight``."""
    indexes = F.sequence(F.lit(0), F.lit(n_trees - 1)) if only is None else F.lit([int(i) for i in only])
    trees = df.withColumn("tree_index", F.explode(indexes)).withColumn("tree_seed", F.lit(seed) + F.col("tree_index"))
    return trees.withColumn("weight", draws(uniform(F.col("tree_seed"), F.col(row_id))) if bootstrap else F.lit(1))


#: Rows of a range of hashes, about, and ranges at most (their counts, half a megabyte, are in every task).
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16


def range_draws(cell: int, upto: np.ndarray, tree_seed: int) -> int:
    """How many of as many draws as there are rows fall into range ``cell``; ``upto``: rows before each range, and all. The
    ranges are halved again and again, and a binomial draw, seeded by tree and half, parts the draws of each two halves."""
    low, high, n, node = 0, len(upto) - 1, int(upto[-1]), 1
    while high - low > 1 and n:
        middle = (low + high) // 2
        all_rows = int(upto[high] - upto[low])
        left = int(np.random.default_rng([tree_seed, node]).binomial(n, (upto[middle] - upto[low]) / all_rows)) if all_rows else 0
        low, high, n, node = (low, middle, left, 2 * node) if cell < middle else (middle, high, n - left, 2 * node + 1)
    return n


def exact_bootstrap(df: DataFrame, row_id: str, n_trees: int, seed: int, only: list[int] | None = None) -> DataFrame:
    """As ``bootstrap_weights``, with exactly as many draws for each tree as there are rows: rows that aren't drawn are left out.

    Rows are dealt into ranges of a hash of their id; a range's number of draws comes by halving (``range_draws``), and its
    draws fall on its rows, in the order of hash and id, inside one task. The same on any partitioning; rows that repeat an
    id are drawn each. No rows give none.
    """
    h, cell = _free("_h", df.columns), _free("_cell", df.columns)
    hashed = df.withColumn(h, (uniform(seed, F.col(row_id)) * 4294967296.0).cast("long"))
    bits = min(MOST_RANGES, max(1, df.count() // RANGE_ROWS)).bit_length() - 1
    dealt = hashed.withColumn(cell, F.shiftright(h, 32 - bits).cast("int"))
    counts = {r[cell]: r["count"] for r in dealt.groupBy(cell).count().collect()}  # MOST_RANGES at most
    upto = np.append(0, np.cumsum([counts.get(i, 0) for i in range(1 << bits)]))
    trees = [int(i) for i in (range(n_trees) if only is None else only)]
    names = df.columns

    def draw(rows: pa.Table) -> pa.Table:
        own, n = int(rows[cell][0].as_py()), len(rows)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(h, "ascending"), (row_id, "ascending")])).select(names)
        parts = []
        for t in trees:
            drawn = np.random.default_rng([seed + t, own, 1]).integers(0, n, range_draws(own, upto, seed + t))
            weight = np.bincount(drawn, minlength=n)
            at = np.flatnonzero(weight)
            more = (pa.array(np.full(len(at), t), pa.int32()), pa.array(np.full(len(at), seed + t), pa.int32()), pa.array(weight[at], pa.int32()))
            parts.append(pa.Table.from_arrays([*rows.take(pa.array(at)).columns, *more], names=[*names, "tree_index", "tree_seed", "weight"]))
        return pa.concat_tables(parts)

    more = [T.StructField(c, T.IntegerType()) for c in ("tree_index", "tree_seed", "weight")]
    return dealt.groupBy(cell).applyInArrow(draw, T.StructType([*df.schema.fields, *more]))


def shard_rows(df: DataFrame, order_by: str, num_shards: int) -> DataFrame:
    """Adds ``shard``: contiguous in the order, of equal sizes, the rest to the last. Ranges and their counts give
    the rank, so no task sorts all rows."""
    from sparkforest.operators.train import stored

    n = max(1, df.count())
    # Stored, for the numbers have to be the same wherever they are read; a lost executor doesn't change them.
    ranged = stored(df.repartitionByRange(F.col(order_by)).sortWithinPartitions(order_by).withColumn("_m", F.monotonically_increasing_id()))
    parts = ranged.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    rank = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.least(F.floor(rank / max(1, n // num_shards)), F.lit(num_shards - 1)).cast("int")
    return ranged.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("_p")).select(*[F.col(f"`{c}`") for c in df.columns], shard.alias("shard"))
