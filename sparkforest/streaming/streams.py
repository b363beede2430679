"""Streams: scoring requests, liveness of keys, running accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sparkforest.operators.score import predict
from sparkforest.plans import models
from sparkforest.sources.io import explode_payload


def predict_stream(stream: DataFrame, nodes: DataFrame, features: list[str], labels: list[str] | None) -> DataFrame:
    """Predictions for a stream of flat requests (request_id, values, n_rows, n_cols); stateless, so it may be replayed."""
    rows = explode_payload(stream, "request_id", "values", "n_rows", "n_cols")
    wide = rows.select("request_id", "row_no", *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(features)])
    return predict(wide, nodes, features, labels).select("request_id", "row_no", "prediction")


def published_stream(stream: DataFrame, root: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer for a stream of requests that name their models (request_id, model_id, values, n_rows, n_cols): each
    micro-batch is scored by ``models.score_requests`` with the registry as it then is, so a model published in
    mid-stream scores the requests after it, and handed to ``write`` with the number of the batch. Nothing is kept between
    batches; a batch that runs again after a failure may use a newer registry, so ``write`` should replace by number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(models.score_requests(rows, root), number)

    return stream.writeStream.foreachBatch(batch)


def liveness_stream(stream: DataFrame, key: str, ts: str, timeout: str = "15 seconds", late: str = "0 seconds") -> DataFrame:
    """(key, since, stale_at, events): a session of a key ends where it has been silent for ``timeout``."""
    events = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    sessions = events.groupBy(F.session_window("_ts", timeout).alias("s"), key).agg(F.count("*").alias("events"))
    return sessions.select(key, F.col("s.start").alias("since"), F.col("s.end").alias("stale_at"), "events")


def accuracy_stream(stream: DataFrame, ts: str, model: str = "model_id", window: str = "1 minute", late: str = "0 seconds") -> DataFrame:
    events = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    right = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    out = events.groupBy(F.window("_ts", window).alias("w"), model).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
    return out.select(model, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "accuracy")
