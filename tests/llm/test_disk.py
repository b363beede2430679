"""What a job leaves on disk."""

import os
import time

from pyspark.sql import functions as F

from sparkforest.llm import _util, line_dedup


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {b for k in range(blocks.size()) if (b := blocks.apply(k).name()).startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(_util.CLEANUP, None)
    stored = _util.Scratch(spark).store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartitionByRange("k"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(_util.CLEANUP, None) == set_to
    assert sorted(map(tuple, stored.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_removed_lines_leave_one_table(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.createDataFrame([(1, "a b c d e f g h i j\nq"), (2, "a b c d e f g h i k j\nq"), (3, "z")], "doc_id long, text string")
    found = line_dedup.repeated(docs)
    assert len(set(os.listdir(folder)) - before) == 1
    assert sorted(map(tuple, found.collect())) == [(2, 0), (2, 1)]
