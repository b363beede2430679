"""Document quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, free, running_total, small_batches

#: The preferred rows that each other row is paired with.
PAIRS = 4
#: The score that stands for the threshold.
CUT = 0.7

FEATURES = ("log_length", "upper", "digit", "symbol", "exclamation", "bar", "other_punctuation", "space", "non_ascii", "word_length", "distinct_words", "distinct_pairs", "repeated_lines", "same_as_before", "symbol_end", "top_word", "upper_words", "short", "empty")
_CLASS = np.full(256, 8, np.int64)  # 8: ASCII letters in lower case
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.isupper() else 1 if _c.isdigit() else 3 if _c == "!" else 4 if _c == "|" else 2 if _c in "#*$%&<>" else 6 if _c.isspace() else 8 if _c.isalpha() else 5
_CLASS[128:] = 7
_SYMBOL_END = re.compile(rb"[#*$%&|<>!](?=\s|$)")


def features(text: str) -> list[float]:
    """Shape of a whole text; an empty text has zeros and the mark ``empty``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n = len(words)
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9) / len(raw)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    same = sum(map(bytes.__eq__, words, words[1:]))
    ids = {w: i for i, w in enumerate(distinct)}
    most = np.bincount(np.fromiter(map(ids.__getitem__, words), np.int64, n)).max()
    upper = sum(map(bytes.isupper, words))
    return [
        math.log1p(len(text)), *share[:8], sum(map(len, words)) / n / 10, math.log(len(distinct)) / math.log(n + 1), len(pairs) / n, 1 - len(set(lines)) / len(lines),
        same / n, len(_SYMBOL_END.findall(raw)) / n, most / n, upper / n, float(n < 10), 0.0,
    ]


def with_features(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([features(t) for t in s], dtype=object)

    return small_batches(docs).withColumn(name, F.pandas_udf(run, "array<double>")(F.coalesce(text, F.lit(""))))


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Rows (``_y``, ``_k``, ``features``) with ``_n``, their number within the label from 1 by the order of a hash of the
    key, and the number of rows of each label. Rows are range-sorted; one row per partition and label is gathered."""
    scratch, order = Scratch(rows.sparkSession), ["_y", "_u", "_k"]
    ranged = rows.withColumn("_u", F.pmod(F.xxhash64("_k"), F.lit(1 << 32))).repartitionByRange(*order).sortWithinPartitions(*order, "features")
    # The id is the partition and, below 33 bits, the place in it.
    local = scratch.store(ranged.select("_y", "features", F.monotonically_increasing_id().alias("_id")).withColumn("_part", F.shiftright("_id", 33)))
    before = Window.partitionBy("_y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = scratch.store(local.groupBy("_y", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows")))
    shifts = parts.select("_y", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    counts = {r["_y"]: r["n"] for r in parts.groupBy("_y").agg(F.sum("_rows").alias("n")).collect()}
    return local.join(F.broadcast(shifts), ["_y", "_part"]).select("_y", (F.col("_id") + F.col("_shift")).alias("_n"), "features"), counts


def preferences(rows: DataFrame, counts: dict[int, int], pairs: int = PAIRS) -> DataFrame:
    """Pairs (``_good``, ``_bad``: numbers; ``won``, ``d``: the outcome and the difference of features for it). Each row of
    label 0 loses against ``pairs`` rows of label 1; one of label 1 that none has drawn draws a row of label 0 itself."""
    good, bad = rows.where("_y = 1"), rows.where("_y = 0")
    draw = lambda p, n: F.pmod(F.xxhash64("_n", p), F.lit(n)) + 1
    drawn = bad.select(F.col("_n").alias("_bad"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)), lambda p: draw(p, counts[1]))).alias("_good"))
    alone = good.join(drawn.select(F.col("_good").alias("_n")).distinct(), "_n", "left_anti").select(draw(F.lit(0), counts[0]).alias("_bad"), F.col("_n").alias("_good"))
    both = drawn.unionAll(alone.select("_bad", "_good"))
    both = both.join(bad.select(F.col("_n").alias("_bad"), F.col("features").alias("_fb")), "_bad").join(good.select(F.col("_n").alias("_good"), F.col("features").alias("_fg")), "_good")
    # Every second one is turned round with its outcome.
    won = F.pmod("_bad", F.lit(2)).cast("double")
    return both.select("_good", "_bad", won.alias("won"), F.zip_with("_fg", "_fb", lambda a, b: F.when(won == 1, a - b).otherwise(b - a)).alias("d"))


def threshold_of(raw: DataFrame, below: int) -> float:
    """The middle between the scores (``s``) of places ``below`` and the next in ascending order, counted from 1."""
    scratch = Scratch(raw.sparkSession)
    ranks = running_total(scratch, raw.groupBy("s").agg(F.count("*").alias("_rows")), [F.col("s")], "_rows")  # equal scores are one row
    found = ranks.agg(*[F.min(F.when(F.col("_run") >= at, F.col("s"))).alias(f"s{k}") for k, at in enumerate((below, below + 1))]).first()
    return (found["s0"] + found["s1"]) / 2


def fit(docs: DataFrame, key: str = "doc_id", label: str = "label", text: str = "text", pairs: int = PAIRS, labels: DataFrame | None = None, features: str | None = None) -> tuple[list[float], float]:
    """Weights of a Bradley-Terry model and the threshold, from rows (key, text) and ``labels`` (key, label 0/1), or
    from rows (key, label, text). ``features``: a column that holds the texts' features already.

    Every labelled row is in a pair: see ``preferences``. The threshold is the quantile of all labelled rows' scores at
    the share of label 0 among them. With one label only, there is nothing to rank: weights 0, every row equal.
    Null labels and null keys are left out; of rows that repeat a key, each counts. Texts don't move, their features do.
    """
    scratch = Scratch(docs.sparkSession)
    named = [F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")]
    rows = docs.select(F.col(features or text).alias("_f"), *(named if labels is None else named[:1]))
    rows = (rows if labels is not None else rows.where("_y in (0, 1)")).where("_k is not null")
    rows = rows.withColumnRenamed("_f", "features") if features else scratch.store(with_features(rows, "_f").drop("_f"))
    if labels is not None:
        rows = rows.join(labels.select(*named).where("_y in (0, 1)"), "_k")
    rows, counts = numbered(rows.select("_y", "_k", "features"))
    if len(counts) < 2:
        return [0.0] * len(FEATURES), 0.0
    diff = scratch.store(preferences(rows, counts, pairs)).select("won", array_to_vector("d").alias("features"))
    model = LogisticRegression(featuresCol="features", labelCol="won", fitIntercept=False, regParam=1e-4, maxIter=60, standardization=True).fit(diff)
    weights = [float(w) for w in model.coefficients]
    return weights, threshold_of(rows.select(raw_score(weights).alias("s")), counts[0])


def raw_score(weights: list[float], features: str = "features"):
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def score(docs: DataFrame, weights: list[float], threshold: float, cut: float = CUT, text: str = "text", features: str | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1; ``cut`` at the threshold) and ``predicted``, from whole texts. Null text: as empty.
    ``features``: a column that holds the texts' features already."""
    docs, shift = docs.drop("score", "predicted"), math.log(cut / (1 - cut)) - threshold
    own = features or free("_features", docs.columns)
    shaped = docs if features else with_features(docs, text, own)
    raw = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), raw_score(weights, own) + shift))
    scored = shaped.withColumn("score", 1 / (1 + F.exp(-raw))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
    return scored if features else scored.drop(own)


def op3_quality_ranking(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    seen = labels.where(~held_out).select("doc_id", F.col("quality").alias("label"))
    docs = Scratch(spark).store(with_features(docs).select("doc_id", "features"))  # for the fit and the scores
    weights, threshold = fit(docs, labels=seen, features="features")
    return score(docs, weights, threshold, features="features").select("doc_id", held_out.alias("held_out"), "score", "predicted")
