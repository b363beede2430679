"""Token ids as ORC files: integer run-length encoded arrays, row indexes, Bloom filters on document ids.

Files are written in ascending document order, one per range partition. ORC readers take stripes in
parallel and skip stripes and row groups by their minima, maxima and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, running_total, scratch_path, small_batches
from sparkforest.llm.tokens import library_encoder


def token_arrays(docs: DataFrame, vocabulary: str, spaced: bool = True, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, ids): ids of each whole text and ``end_id``, in ascending order of the key, and of a hash of the
    text for rows that repeat a key.

    ``seq`` numbers the rows in that order (with holes), so that repeated keys stay apart. Null text: the end
    id alone. Null keys come first.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seq = library_encoder(vocabulary, spaced), TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for ids, ends in enc.slices(b.column(1).to_pylist()):
                n = len(ends)
                values, stops = np.full(len(ids) + n, end_id, np.int32), ends.astype(np.int64) + np.arange(1, n + 1)
                inside = np.ones(len(values), bool)
                inside[stops - 1] = False  # the end ids
                values[inside] = ids
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int64()), pa.array(values))
                seqs = pa.array(np.arange(seq, seq + n), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), seqs, lists.cast(pa.list_(pa.int32()))], names=[key, "seq", "ids"])
                at, seq = at + n, seq + n

    few = small_batches(docs).select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    ranged = few.withColumn("_h", F.xxhash64("_t")).repartitionByRange("_k", "_h").sortWithinPartitions("_k", "_h", "_t").select("_k", "_t")
    return ranged.mapInArrow(run, f"`{key}` {kind}, seq long, ids array<int>")


def write_token_files(tokens: DataFrame, path: str, key: str = "doc_id", bloom_fpp: float = 0.01, stripe_mb: int = 64, row_index_stride: int = 1000) -> None:
    """Write the rows as they are partitioned and sorted. ORC stores the ids with its integer run-length encoding."""
    writer = tokens.write.option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", bloom_fpp)
    writer = writer.option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", row_index_stride)
    writer.option("orc.create.index", "true").option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str, kind: str = "long", key: str = "doc_id") -> DataFrame:
    return spark.read.schema(f"`{key}` {kind}, seq long, ids array<int>").orc(path)


def token_index(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of rows read from token files; ``start`` counts the ids before."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=[key, "seq", "n_tokens", "ids_crc32"])

    sums = files.select(key, "seq", "ids").mapInArrow(run, f"`{key}` {kind}, seq long, n_tokens long, ids_crc32 long")
    scratch = Scratch(files.sparkSession)
    # Stored, for the range sort looks at its rows twice and the files are read once.
    total = running_total(scratch, scratch.store(sums), [F.col("seq")], "n_tokens")
    return total.select(key, (F.col("_run") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark)
    write_token_files(token_arrays(docs, public_tokenizers.path("byte_bpe_50k.json")), path)
    return token_index(read_token_files(spark, path))
