"""Mixing sources to target weights, in blocks of a fixed number of words.

The documents of a source stand in a pseudorandom order, and their words in a row, cut into blocks of equal length. A
target becomes a number of slots. A source's slots fall on the output shards by a multinomial draw, so a shard's counts
by source are a draw from the whole mix, and each source's total is exact. Slot k of a source takes the block that a
pseudorandom permutation of its block numbers has at k; each further pass over the source has a permutation of its
own. Slots and blocks meet in a join by (source, block number). Everything follows from seeds, keys and texts, so runs
agree whatever the partitions. Texts move only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, running_total

#: Words of a block, slots that a shard has on average, shards that share a draw.
BLOCK_WORDS, SHARD_SLOTS, SHARD_GROUP = 256, 4096, 1024
#: A source gives its words so many times at most.
MOST_TIMES = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Parts into which the rows of a source are dealt where they meet its sums.
SALTS = 32

_WORD = r"[^\x20\x09-\x0D]++"


class Permutation:
    """A pseudorandom permutation of 0 to n - 1: four Feistel rounds over the next even number of bits, walked on
    until the value is below n (four steps on average at most)."""

    def __init__(self, n: int, *seed: int):
        self.n, self.half = n, np.uint64((max(2, (n - 1).bit_length()) + 1) // 2)
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = np.random.default_rng(seed).integers(0, 2**63, 4).astype(np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out, todo = np.asarray(x, np.uint64).copy(), np.arange(len(x))
        while len(todo):
            left, right = out[todo] >> self.half, out[todo] & self.mask
            for key in self.keys[::-1] if back else self.keys:
                left, right = (right ^ self._mixed(left, key), left) if back else (right, left ^ self._mixed(right, key))
            out[todo] = (left << self.half) | right
            todo = todo[out[todo] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def targets(sums: DataFrame, weight: str = "weight", size: str = "source_size", most: int = MOST_TIMES) -> DataFrame:
    """Adds ``target``: the sum of all sizes shared by weight, where none gets more than ``most`` times its size and
    the excess is shared again by weight among the others until none is above. Sizes of 0 get 0.

    Each round is one aggregate over the rows; the share of a weight only grows, and so does the set of capped rows.
    """
    cap, share, capped = most * F.col(size), 0.0, -1
    total = sums.agg(F.sum(size)).first()[0] or 0
    while True:
        above = cap <= share * F.col(weight)
        row = sums.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col(weight)))).first()
        if row[0] == capped or not row[2]:
            break
        capped, share = row[0], (total - (row[1] or 0)) / row[2]
    return sums.withColumn("target", F.least(cap.cast("double"), F.lit(float(share)) * F.col(weight)))


def source_sums(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """(source, sid, weight, source_size, begin, target): sources numbered by code point, null last; ``begin`` is the
    sum of all sizes before the source's in the order of ``placed``."""
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(F.col("_run") - F.col("size")).alias("begin"), F.lit(1).alias("one"))
    numbered = running_total(scratch, scratch.store(sums), [F.col("source").isNull(), F.col("source")], "one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (1 + F.pmod(F.col("_run") - 1, F.lit(len(WEIGHTS)))).cast("int"))
    return scratch.store(targets(numbered.select("source", F.col("_run").alias("sid"), weight.alias("weight"), "source_size", "begin")))


def slot_plan(size: int, words: int, block: int, seed: int, sid: int) -> tuple[int, int, int]:
    """(slots, blocks, words of the last slot) of a source of ``size`` words that gives ``words`` of them: whole passes,
    then blocks of one more permutation until the words are reached; the last one is cut there."""
    blocks = -(-size // block)
    passes, rest = divmod(words, size) if size else (0, 0)
    if not rest:
        return passes * blocks, blocks, block  # whole blocks alone
    short = block * blocks - size  # what the last block lacks
    at = int(Permutation(blocks, seed, sid, passes).inverse(np.array([blocks - 1]))[0])
    more = -(-rest // block)
    if more > at:
        more = max(more, -(-(rest + short) // block))
    return passes * blocks + more, blocks, rest - ((more - 1) * block - (short if at < more - 1 else 0))


def slots(sums: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, place, sid, slot, block, words): the slots of all sources. ``place`` orders a shard's slots."""
    total = sums.agg(F.sum(F.ceil(F.col("target") / block))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_slots))
    groups = np.minimum(SHARD_GROUP, shards - SHARD_GROUP * np.arange(-(-shards // SHARD_GROUP)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, size, target in zip(b["sid"].tolist(), b["source_size"].tolist(), b["target"].tolist()):
                n, blocks, last = slot_plan(size, round(target), block, seed, sid)
                count = np.random.default_rng([seed, sid]).multinomial(n, groups / groups.sum())
                some = np.flatnonzero(count)
                yield pd.DataFrame({"sid": sid, "size": size, "blocks": blocks, "of": n, "last": last, "shards": some, "first": (np.cumsum(count) - count)[some], "n": count[some]})

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rng = np.random.default_rng([seed, r.sid, r.shards])
                count = rng.multinomial(r.n, np.full(groups[r.shards], 1 / groups[r.shards]))
                shard = np.repeat(r.shards * SHARD_GROUP + np.arange(len(count)), count)
                for at in range(0, r.n, 100_000):
                    part = slice(at, at + 100_000)
                    slot = r.first + np.arange(at, min(r.n, at + 100_000))
                    taken = np.empty(len(slot), np.int64)
                    for turn in np.unique(slot // r.blocks).tolist():
                        own = slot // r.blocks == turn
                        taken[own] = Permutation(r.blocks, seed, r.sid, turn)(slot[own] % r.blocks)
                    words = np.where(slot == r.of - 1, np.minimum(r.last, r.size - taken * block), np.minimum(block, r.size - taken * block))
                    place = np.random.default_rng([seed, r.sid, r.shards, at, 1]).integers(0, 2**62, len(slot))
                    yield pd.DataFrame({"shard": shard[part], "place": place, "sid": r.sid, "slot": slot, "block": taken, "words": words})

    dealt = sums.select("sid", "source_size", "target").mapInPandas(deal, "sid long, size long, blocks long, of long, last long, shards long, first long, n long")
    return dealt.repartition("sid", "shards").mapInPandas(draw, "shard long, place long, sid long, slot long, block long, words long")


class Mix:
    """A mix of ``docs`` by words. ``sums``: the sources with their sizes and targets. ``documents``: each row's key,
    digest of its text, source, size, and the place ``at`` of its first word in its source. ``slots``: see ``slots``.

    Rows with null or empty texts have size 0 and no words in the mix; a null source is a source, the last one. Null
    keys stay. Rows that repeat a key are rows of their own, and equal rows follow each other in any order. Other
    columns, of any name, take no part.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, seed: int = 0):
        self.docs, self.key, self.text, self.block, scratch = docs, key, text, block, Scratch(docs.sparkSession)
        size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
        rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("digest"), size.alias("size"))
        order = [F.col("source").isNull(), F.col("source"), F.xxhash64(F.lit(seed), "key"), F.col("key"), F.col("digest")]
        # Stored, for the range sort looks at its rows twice and the texts are read once.
        placed = running_total(scratch, scratch.store(rows), order, "size")
        self.sums = source_sums(scratch, placed)
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        known = self.sums.select(F.col("source").alias("of"), "sid", "source_size", "target", "begin", salt)
        dealt = placed.withColumn("turn", F.pmod("_idx", F.lit(SALTS)).cast("int"))
        joined = dealt.join(known, F.col("source").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("salt")))
        row = F.shiftleft(F.col("_part").cast("long"), 40) + F.col("_idx")
        self.documents = scratch.store(joined.select(row.alias("row"), "key", "digest", "source", "sid", "size", "source_size", "target", (F.col("_run") - F.col("size") - F.col("begin")).alias("at")))
        # Stored, so that joins see its size: it is made from few rows, by which Spark would take it for small.
        self.slots = scratch.store(slots(self.sums, block, seed=seed))

    def pieces(self) -> DataFrame:
        """(row, key, sid, block, start, skip, n): the words of each document by the blocks that they fall in. ``start``
        is a word's number in the document, ``skip`` how many of the block's words stand before it."""
        last = F.expr(f"div(at + size - 1, {self.block})")
        cut = self.documents.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"div(at, {self.block})"), last)).alias("block"))
        start = F.greatest(F.lit(0), F.col("block") * self.block - F.col("at"))
        skip = F.greatest(F.lit(0), F.col("at") - F.col("block") * self.block)
        return cut.select("row", "key", "digest", "sid", "block", start.alias("start"), skip.alias("skip"), F.least(F.col("size") - start, self.block - skip).alias("n"))

    def rows(self) -> DataFrame:
        """(shard, place, sid, slot, block, row, key, start, skip, n): what each slot holds, a row for each document."""
        both = self.slots.join(self.pieces(), ["sid", "block"]).where(F.col("skip") < F.col("words"))
        return both.select("shard", "place", "sid", "slot", "block", "row", "key", "start", "skip", F.least("n", F.col("words") - F.col("skip")).alias("n"))

    def texts(self) -> DataFrame:
        """(shard, place, sid, text): the words of each slot, joined by a space. A document's text moves once, to its
        places, and is cut there; the words of a block, a bounded number, meet at its slots."""
        from sparkforest.llm._util import WORD_BREAK

        once = self.docs.select(F.col(self.key).alias("k"), F.col(self.text).alias("t"), F.xxhash64(self.text).alias("d")).where("t is not null").dropDuplicates(["k", "d"])
        lists = self.pieces().groupBy("row").agg(F.first("key").alias("key"), F.first("digest").alias("digest"), F.first("sid").alias("sid"), F.collect_list(F.struct("block", "start", "skip", "n")).alias("p"))
        met = lists.join(once, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")))
        words = met.select("row", "sid", "p", F.array_remove(F.split("t", WORD_BREAK), "").alias("w"))
        parts = words.select("row", "sid", "w", F.explode("p").alias("p")).select("row", "sid", "p.block", "p.skip", F.slice("w", (F.col("p.start") + 1).cast("int"), F.col("p.n").cast("int")).alias("w"))
        held = self.slots.join(parts, ["sid", "block"]).where(F.col("skip") < F.col("words"))
        held = held.select("shard", "place", "sid", "slot", F.struct("skip", F.slice("w", F.lit(1), (F.col("words") - F.col("skip")).cast("int")).alias("w")).alias("part"))
        whole = held.groupBy("shard", "place", "sid", "slot").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        return whole.select("shard", "place", "sid", F.array_join(F.flatten("parts.w"), " ").alias("text"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``documents``: its words, those of its source, the words
    that its source is to give, and those of the document that the mix has, repeats counted. See ``Mix``."""
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mix.rows().groupBy("row").agg(F.sum("n").alias("taken"))
    out = mix.documents.join(taken, "row", "left")
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
