"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous rounds over (piece, length) and (sequence, gap) rows. In a round both are range-sorted by
size, pieces before gaps of the same size. A distributed running total (+1 for a piece, -1 for a gap) gives
every row its rank level, and on a level pieces and gaps alternate: the next row on a piece's level is its
successor gap, so pieces that want the same gap are told apart by rank and every gap gets the largest piece
that is left for it. Gaps shrink and the next round begins. Text and ids take no part in the rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, running_total, small_batches
from sparkforest.llm.tokens import library_encoder

CAPACITY = 2048


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, piece, start, length, ids_crc32): the pieces of each row's ids and ``end_id``.

    Only documents over ``capacity`` are cut. Null text counts as empty, which is one piece: the end id alone.
    Repeated rows are packed each for itself; ``uid`` tells them apart.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end = library_encoder(vocabulary, spaced=False), np.array([end_id], "<u4").tobytes()
        uid, step = TaskContext.get().partitionId() << 40, 4 * capacity
        for b in batches:
            rows = []
            for k, ids in zip(b["_k"], enc.encode(b["_t"].tolist())):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((uid, k, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            yield pd.DataFrame(rows, columns=["uid", key, "piece", "start", "length", "ids_crc32"])

    few = small_batches(docs).select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    return few.mapInPandas(run, f"uid long, `{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Where each piece goes: (uid, sequence_id, length, offset). ``pieces`` has (uid, length), stored.

    ``uid`` is unique and not negative; lengths lie from 1 to ``capacity``. Pieces of over half the capacity
    open a sequence each, since no two of them share one. Further sequences are opened only as far as the
    open gaps can't hold what is left. The result is gapless in every sequence. No pieces: no rows.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    half = capacity // 2
    own = pieces.where(F.col("length") > half).select("uid", F.col("uid").alias("bin"), "length")
    items = scratch.store(pieces.where(F.col("length") <= half).select("uid", "length"))
    gaps = scratch.store(own.select("bin", (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0"))
    placed, opened, stats = [own], 0, None
    while True:
        todo = items.agg(F.count("*").alias("n"), F.sum("length").alias("sum"), F.max("length").alias("max"), F.min("length").alias("min")).first()
        if not todo["n"]:
            break
        room = gaps.where(F.col("gap") >= todo["min"]).agg(F.count("*").alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("sum"), F.coalesce(F.max("gap"), F.lit(0)).alias("max")).first()
        short = max(0, todo["sum"] - room["sum"])
        if todo["max"] > room["max"]:  # these fit nowhere
            short = max(short, items.where(F.col("length") > room["max"]).agg(F.sum("length")).first()[0])
        need = -(-short // capacity)
        fresh = spark.range(need).select((-F.col("id") - 1 - opened).alias("bin"), F.lit(capacity).cast("long").alias("gap"))
        opened += need
        now = gaps.where(F.col("gap") >= todo["min"]).unionByName(fresh)
        # A gap with room for several of the largest pieces takes several in one round.
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / todo["max"]), F.lit(-(-todo["n"] // max(1, room["n"] + need)))))
        split = now.withColumn("slots", slots.cast("int")).select("bin", F.floor(F.col("gap") / F.col("slots")).alias("size"), F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"))
        events = items.select(F.col("length").alias("size"), F.lit(1).alias("step"), F.col("uid").alias("id"), F.lit(0).alias("slot"))
        events = events.unionByName(split.select("size", F.lit(-1).alias("step"), F.col("bin").alias("id"), "slot"))
        events = events.withColumn("tie", F.xxhash64("id", "slot"))
        swept = running_total(scratch, events, [F.col("size"), F.col("step").desc(), F.col("tie")], "step")
        level = F.when(F.col("step") == 1, F.col("_run")).otherwise(F.col("_run") + 1)
        along = Window.partitionBy("level").orderBy("_part", "_idx")
        after = swept.withColumn("level", level).withColumn("next_step", F.lead("step").over(along)).withColumn("next_id", F.lead("id").over(along))
        result = scratch.store(after.where("step = 1").select(F.col("id").alias("uid"), F.when(F.col("next_step") == -1, F.col("next_id")).alias("bin"), F.col("size").alias("length")))
        scratch.drop(swept)
        got = result.where("bin is not null")
        placed.append(got)
        used = got.select("bin", (-F.col("length")).alias("gap"))
        new_gaps = scratch.store(now.unionByName(used).groupBy("bin").agg(F.sum("gap").alias("gap")).where("gap > 0"))
        scratch.drop(gaps)
        items, gaps = result.where("bin is null").select("uid", "length"), new_gaps
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    before = Window.partitionBy("bin").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    # A sequence holds at most ``capacity`` pieces, so these groups are bounded.
    return out.select("uid", F.col("bin").alias("sequence_id"), "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut, then pack all documents: (key, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.store(token_pieces(docs, vocabulary, capacity, end_id, key, text))
    where = best_fit(pieces.select("uid", "length"), capacity, scratch)
    return pieces.join(where.drop("length"), "uid").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
