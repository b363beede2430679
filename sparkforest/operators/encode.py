"""One-hot encoding with missing indicators, and label indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: More dummy columns than this are an error.
MAX_CATEGORIES = 2000


def string_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target]


def fit_vocab(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values of each column, in one pass; the vocabulary is bounded by ``max_categories``."""
    if not columns:
        return {}
    few = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(str(i)) for i, c in enumerate(columns)]).first()
    if sum(few) > max_categories * 1.2:
        raise ValueError(f"{sum(few)} categories are more than {max_categories}")
    row = df.agg(*[F.sort_array(F.collect_set(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    vocab = {c: list(row[i]) for i, c in enumerate(columns)}
    names = [n.lower() for c, vs in vocab.items() for n in (*(f"{c}_{v}" for v in vs), f"{c}_nan")] + [c.lower() for c in df.columns if c not in columns]
    if len(names) != len(set(names)):
        raise ValueError("generated column names clash")
    return vocab


def divide_columns(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> tuple[list[str], list[str]]:
    """(columns to encode one by one, columns to encode by codes): those with the fewest values first, as long as all their
    values together are at most ``max_categories``, by an approximate count."""
    if not columns:
        return [], []
    few = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(str(i)) for i, c in enumerate(columns)]).first()
    total, chosen = 0, set()
    for n, c in sorted(zip(few, columns)):
        total += n
        if total <= max_categories:
            chosen.add(c)
    return [c for c in columns if c in chosen], [c for c in columns if c not in chosen]


def category_codes(df: DataFrame, columns: list[str], label: str, n_classes: int | None) -> DataFrame:
    """(column, value, n, mean, code): the values of each column in the order of their mean label, numbered from 0.

    The mean is of the label (regression), or the share of class 1 of two, or of the most frequent of more classes. A cut
    of these codes is the best subset of values that a split of all rows can have, for two classes and for variance; below
    the root, and for more classes, it is one of many. Null is a value. Equal means follow the value. Values stay in a
    table: they are counted, range-sorted and numbered by ranges, and none is gathered.
    """
    from sparkforest.operators.train import stored

    score = F.col(label)
    if n_classes is not None:
        top = 1 if n_classes == 2 else df.groupBy(label).count().orderBy(F.desc("count"), label).first()[0]
        score = F.when(F.col(label) == top, 1.0).otherwise(0.0)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("p")
    counted = df.select(score.alias("s"), pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    order = ["column", "mean", F.col("value").isNotNull(), "value"]
    ranged = stored(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ends = ranged.groupBy(part.alias("_p"), "column").agg(F.count("*").alias("_n"), F.min(inside).alias("_first"))
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ends.select("_p", F.col("column").alias("_c"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_o"))
    coded = ranged.join(offsets, (part == F.col("_p")) & (F.col("column") == F.col("_c")))
    return coded.select("column", "value", "n", "mean", (inside + F.col("_o")).alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Each of ``columns`` as its value's code, a double; -1, which is below all, for a value that has none. A join for
    each column, of any number of values; rows stay, and the columns keep their places."""
    out = df
    for i, c in enumerate(columns):
        own = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").cast("double").alias(f"_code{i}"))
        joined = out.join(own, out[f"`{c}`"].eqNullSafe(own[f"_v{i}"]), "left")
        out = joined.select(*[F.coalesce(f"_code{i}", F.lit(-1.0)).alias(x) if x == c else F.col(f"`{x}`") for x in out.columns])
    return out


def one_hot(df: DataFrame, vocab: dict[str, list[str]], target: str | None = None) -> DataFrame:
    """Other columns in order, then a 0/1 column for each value and one for null; the target last. Values outside
    the vocabulary have zeros."""
    out = [F.col(f"`{c}`") for c in df.columns if c not in vocab and c != target]
    for c, values in vocab.items():
        out += [F.when(F.col(f"`{c}`") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in values]
        out.append(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0).alias(f"{c}_nan"))
    return df.select(*out, *([F.col(f"`{target}`")] if target else []))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each column's values, null and NaN apart: the lower middle one. 0 for a column without any.

    Values are counted, range-sorted and stored; the counts of ranges tell in which one the middle lies, and only that
    range is gone through. No task holds more than a range."""
    from sparkforest.operators.train import stored

    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)])).alias("p")
    counted = df.select(pairs).select("p.*").where("value is not null and not isnan(value)").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranged = stored(counted.repartitionByRange("column", "value").withColumn("_p", F.spark_partition_id()))
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in ranged.groupBy("column", "_p").agg(F.sum("n").alias("n")).orderBy("column", "_p").collect():  # a row for each range
        parts.setdefault(r["column"], []).append((r["_p"], r["n"]))
    found = {}
    for i, sizes in parts.items():
        left = (sum(n for _, n in sizes) + 1) // 2
        for p, n in sizes:
            if left <= n:
                break
            left -= n
        found[i] = (p, left)
    if not found:
        return dict.fromkeys(columns, 0.0)
    asked = df.sparkSession.createDataFrame([(i, p, left) for i, (p, left) in found.items()], "column int, _p int, _left long")
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    inside = ranged.join(F.broadcast(asked), ["column", "_p"]).withColumn("_upto", upto)
    middle = {r["column"]: r["value"] for r in inside.where("_upto >= _left").groupBy("column").agg(F.min("value").alias("value")).collect()}
    return {c: float(middle.get(i, 0.0)) for i, c in enumerate(columns)}


def fill_missing(df: DataFrame, fill: dict[str, float], indicators: list[str]) -> DataFrame:
    """Each column of ``fill`` with that value where it is missing (null, NaN); after all columns ``<column>_missing`` for
    each of ``indicators``, 1 where it was missing, else 0. Columns of those names are an error."""
    known = {c.lower() for c in df.columns}
    if clash := [f"{c}_missing" for c in indicators if f"{c}_missing".lower() in known]:
        raise ValueError(f"generated column names clash: {clash}")
    lacks = lambda c: F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
    out = [F.when(lacks(c), F.lit(fill[c])).otherwise(F.col(f"`{c}`").cast("double")).alias(c) if c in fill else F.col(f"`{c}`") for c in df.columns]
    return df.select(*out, *[F.when(lacks(c), 1.0).otherwise(0.0).alias(f"{c}_missing") for c in indicators])


def label_index(df: DataFrame, target: str) -> DataFrame:
    """(label, idx): distinct labels in the order of their strings, from 0."""
    labels = df.select(F.col(target).cast("string").alias("label")).where("label is not null").distinct()
    return labels.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)  # one row per class


def class_labels(df: DataFrame, target: str) -> list[str]:
    if not df.where(F.col(target).isNull()).isEmpty():
        raise ValueError("the target has nulls")
    return [r["label"] for r in label_index(df, target).orderBy("idx").collect()]


def fallback_labels(df: DataFrame, column: str) -> list[str]:
    """'0' to the largest integer label, where no labels are given."""
    return [str(i) for i in range(int(df.agg(F.max(column)).first()[0]) + 1)]
