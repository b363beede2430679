"""Results that a collision of hashes, or a user's column of an operator's name, must not change."""

import time

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkforest.llm import language, line_dedup, quality_rules

P1, P2, ALL = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def turned(acc, lane):
    x = (acc + lane * P2) & ALL
    return ((x << 31 | x >> 33) & ALL) * P1 & ALL


@pytest.fixture(scope="module")
def twins():
    """Two printable words of 64 bytes with one xxhash64 of seed 42: the second stripe makes up for the first."""
    start = (42 + P1 + P2) & ALL
    word = bytearray(b"q" * 64)
    first, second = (int.from_bytes(word[i : i + 8], "little") for i in (0, 32))
    for k in range(1_000_000):
        other = b"%08d" % k
        acc = turned(start, int.from_bytes(other, "little"))
        lane = (second + (turned(start, first) - acc) * pow(P2, -1, 1 << 64)) & ALL
        raw = lane.to_bytes(8, "little")
        if all(33 <= c < 127 for c in raw):
            twin = bytearray(word)
            twin[0:8], twin[32:40] = other, raw
            a, b = word.decode(), twin.decode()
            assert a != b and xxhash.xxh64(a, seed=42).digest() == xxhash.xxh64(b, seed=42).digest()
            return a, b
    raise AssertionError("no collision found")


def test_lines_are_compared_by_words(spark, twins):
    a, b = twins
    assert spark.createDataFrame([(a, b)], "a string, b string").select(F.xxhash64("a") == F.xxhash64("b")).first()[0]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"x y z {a} w"), (5, f"x y z {b} w")], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.repeated(docs).collect())) == [(3, 0)]


def test_repeats_are_confirmed_on_words(spark, twins):
    a, b = twins
    docs = spark.createDataFrame([(1, f"{a} c d e f {b} c d e f"), (2, f"{a} c d e f {a} c d e f")], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judge(docs, quality_rules.References(docs.withColumn("lang", F.lit("en")))).collect()}
    assert out == {1: (0, False), 2: (10, True)}


def test_references_of_many_languages_plan_fast():
    ref = object.__new__(quality_rules.References)
    ref.hashes = sorted(xxhash.xxh64(f"word{i}").intdigest() - (1 << 63) for i in range(5000))
    began = time.time()
    ref.slots = quality_rules.slots_of(ref.hashes)
    assert time.time() - began < 1 and len(ref.slots) <= 8 * 5000
    assert sorted(i for i in ref.slots if i >= 0) == list(range(5000))
    assert all(any(ref.slots[p] == i for p in quality_rules.places(h, len(ref.slots))) for i, h in enumerate(ref.hashes))


def test_stages_keep_columns_of_the_operators_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = docs.withColumns({"Score": F.lit("mine"), "lang_pred": F.lit("its"), "kept": F.lit("yours"), "n_removed": F.lit("ours"), "word_chars": F.lit("x")})
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        plain, own = stage(spark, plain, ""), stage(spark, own, "")
        assert own.columns == [*docs.columns, "Score", "lang_pred", "kept", "n_removed", "word_chars"], name
        rows = own.collect()
        assert {(r["Score"], r["lang_pred"], r["kept"], r["n_removed"], r["word_chars"]) for r in rows} == {("mine", "its", "yours", "ours", "x")}, name
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, plain.collect())), name


def test_columns_of_another_case(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "x", "y", "z")], "doc_id long, text string, Score string, Kept string, N_removed string")
    assert language.identify(docs, {"en": [1]}).first()["score"] >= 0
    assert quality_rules.judge(docs, quality_rules.References(docs.withColumn("lang", F.lit("en")))).first()["kept"] is False
    assert line_dedup.dedup_lines(docs).first()["n_removed"] == 0
