"""Mixing against the plain rules: targets, whole passes, words of each slot, equal reruns."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, none, odd  # noqa: F401

from sparkforest.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """{source: target} of {source: size}, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        open_ -= above
    return out


def check(rows, docs):
    """rows: (doc_id, size, source_size, target, taken); docs: (doc_id, text, source)."""
    size = collections.Counter()
    for _, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    want = plain_targets(size)
    assert collections.Counter((k, n, s, round(t, 4)) for k, n, s, t, _ in rows) == collections.Counter((k, len(WORD.findall(x or "")), size[s], round(want[s], 4)) for k, x, s in docs)
    assert all(0 <= taken <= 3 * n for _, n, _, _, taken in rows)
    taken = collections.Counter()
    source_of = {k: s for k, _, s in docs}
    for k, _, _, _, n in rows:
        taken[source_of[k]] += n
    assert {s: taken[s] for s in size} == {s: round(want[s]) for s in size}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 63, 64, 65, 1000])
def test_permutations(n):
    every = np.arange(n)
    p = mixing.Permutation(n, 1, 2)
    assert sorted(p(every).tolist()) == every.tolist() and (p.inverse(p(every)) == every).all()
    assert n < 63 or (p(every) != mixing.Permutation(n, 1, 3)(every)).any()


def test_slots_reach_the_words_exactly():
    rng = np.random.default_rng(1)
    for sid in range(400):
        size, block = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        words = int(rng.integers(0, 3 * size + 1))
        n, blocks, last = mixing.slot_plan(size, words, block, 0, sid)
        total = 0
        for k in range(n):
            taken = int(mixing.Permutation(blocks, 0, sid, k // blocks)(np.array([k % blocks]))[0])
            whole = min(block, size - taken * block)
            assert k < n - 1 or last >= 1
            total += min(last, whole) if k == n - 1 else whole
        assert total == words


def test_rows_of_any_kind(spark, odd, none):  # noqa: F811
    docs = odd.withColumn("source", F.when(F.col("doc_id") == 6, None).when(F.col("doc_id") > 4, "b").otherwise(F.col("source"))).withColumn("size", F.lit("mine")).withColumn("sid", F.lit(1))
    mix = mixing.Mix(docs, block=7)
    taken = mix.rows().groupBy("row").agg(F.sum("n").alias("taken"))
    rows = [tuple(r) for r in mix.documents.join(taken, "row", "left").select("key", "size", "source_size", "target", F.coalesce("taken", F.lit(0))).collect()]
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = plain_targets(size)
    assert len(rows) == docs.count() and all(t <= 3 * n for _, n, _, _, t in rows)
    assert sum(t for *_, t in rows) == sum(round(x) for x in want.values())
    assert {r["source"]: r["target"] for r in mix.sums.collect()} == pytest.approx(want)
    assert mixing.Mix(none).rows().collect() == [] and mixing.Mix(none).documents.collect() == []


def test_texts_are_the_words_of_the_slots(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(n)), f"s{i % 3}") for i, n in enumerate([0, 1, 5, 40, 3, 12, 100, 7, 2])], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=8)
    by_slot = collections.defaultdict(list)
    for r in mix.rows().collect():
        by_slot[r["shard"], r["place"], r["sid"]].append((r["skip"], [f"d{r['key']}w{j}" for j in range(r["start"], r["start"] + r["n"])]))
    want = {k: " ".join(w for _, ws in sorted(v) for w in ws) for k, v in by_slot.items()}
    assert {(r["shard"], r["place"], r["sid"]): r["text"] for r in mix.texts().collect()} == want
    assert max(len(t.split()) for t in want.values()) <= 8


def test_shards_hold_what_their_sources_weigh(spark):
    sums = spark.createDataFrame([(1, 400_000, 500_000.0), (2, 900_000, 100_000.0), (3, 1, 3.0)], "sid long, source_size long, target double")
    rows = mixing.slots(sums, block=4, shard_slots=5000, seed=3).groupBy("sid", "shard").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()
    assert {s: sum(r["words"] for r in rows if r["sid"] == s) for s in (1, 2, 3)} == {1: 500_000, 2: 100_000, 3: 3}
    big = [r["n"] for r in rows if r["sid"] == 1]
    assert len(big) == 31 and all(abs(n - 125_000 / 31) < 6 * (125_000 / 31) ** 0.5 for n in big)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = [tuple(r) for r in queries.queries()["op13_source_mixing"](spark, SF).collect()]
    check(rows, docs)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(tuple(r) for r in queries.queries()["op13_source_mixing"](spark, SF).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
