"""Metrics of predictions, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(true_label, pred_label, n) over all pairs of labels that occur on either side."""
    counts = df.groupBy(F.col(label).cast("string").alias("true_label"), F.col(prediction).cast("string").alias("pred_label")).agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("true_label", "pred_label")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("true_label")).crossJoin(labels.select(F.col("l").alias("pred_label")))  # classes, not rows
    return grid.join(counts, ["true_label", "pred_label"], "left").fillna(0, ["n"])


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    same = F.col(label).cast("string") == F.col(prediction).cast("string")
    return df.agg(F.count("*").alias("n"), F.avg(F.when(same, 1.0).otherwise(0.0)).alias("accuracy"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support); a ratio over nothing is 0."""
    cells = confusion_matrix(df, label, prediction)
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    each = cells.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    return sums.select("label", _zero(F.col("tp"), F.col("predicted")).alias("precision"), _zero(F.col("tp"), F.col("support")).alias("recall"), _zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report."""
    ms = ("precision", "recall", "f1")
    macro = report.agg(*[F.avg(m).alias(m) for m in ms], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *ms, "support")
    weighted = report.agg(*[_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in ms], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *ms, "support")
    return macro.unionByName(weighted)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, mse, rmse and r2 = 1 - SSE / SST, over two passes; a constant target has 1 if it is met exactly, else 0."""
    mean = df.agg(F.avg(label).alias("_mean"))
    e, d = F.col(label) - F.col(prediction), F.col(label) - F.col("_mean")
    sums = df.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum(d * d).alias("sst"))  # one row
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return sums.select("n", (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), r2.alias("r2"))


def evaluate(df: DataFrame, task_type: str) -> DataFrame:
    """One row: (n, accuracy, mse, rmse, r2), those of the other task null."""
    none = [F.lit(None).cast("double").alias(c) for c in ("mse", "rmse", "r2")]
    if task_type == "classification":
        return accuracy(df).select("n", "accuracy", *none)
    return regression_metrics(df).select("n", F.lit(None).cast("double").alias("accuracy"), "mse", "rmse", "r2")


def evaluate_each(df: DataFrame, task_type: str, by: str) -> DataFrame:
    """As ``evaluate``, a row for each value of ``by`` (few: the experiments of a grid), in one pass; two for a mean."""
    none = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    if task_type == "classification":
        same = F.col("label").cast("string") == F.col("prediction").cast("string")
        return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(same, 1.0).otherwise(0.0)).alias("accuracy")).select(by, "n", "accuracy", *none("mse", "rmse", "r2"))
    met = df.join(df.groupBy(by).agg(F.avg("label").alias("_mean")), by)
    e, d = F.col("label") - F.col("prediction"), F.col("label") - F.col("_mean")
    sums = met.groupBy(by).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum(d * d).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return sums.select(by, "n", *none("accuracy"), (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), r2.alias("r2"))


def feature_importances(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(feature, importance): rows times gain over a feature's nodes, normalised in each tree, averaged."""
    own = nodes.where("feature >= 0").groupBy("tree_index", "feature").agg(F.sum(F.col("count") * F.col("gain")).alias("g"))
    total = own.groupBy("tree_index").agg(F.sum("g").alias("t"))
    shares = own.join(total, "tree_index").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    n = nodes.select("tree_index").distinct().agg(F.count("*").alias("n"))
    table = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    return table.join(shares, "feature", "left").crossJoin(F.broadcast(n)).select(F.col("name").alias("feature"), F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("importance"))
