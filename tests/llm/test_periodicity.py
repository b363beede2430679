"""Periodic runs against the definition, word by word."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, none, odd  # noqa: F401

from sparkforest.llm import periodicity, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """(start, length, period): for each period, stretches of equal words a period apart; the smallest of a stretch stays."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in best.items())


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_row(key, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(key).encode())
    if words and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (key, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(brute_kept(words, runs))))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=9)).map(lambda x: x[2] + x[0] * x[1] + x[2])), max_size=5))
def test_runs_are_those_of_the_definition(texts):
    found, left = periodicity.collapse([" ".join(f"w{i}" for i in t) for t in texts])
    for t, runs, rest in zip(texts, found, left):
        want = brute_runs(t)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert rest == " ".join(f"w{i}" for i in brute_kept(t, want))


def test_long_texts_of_one_word_and_of_one_long_period():
    found, left = periodicity.collapse(["a " * 50_000, " ".join(str(i % 7001) for i in range(30_000))])
    assert [list(r.values()) for r in found[0]] == [[0, 50_000, 1]] and left[0] == "a"
    assert [list(r.values()) for r in found[1]] == [[0, 30_000, 7001]] and len(left[1].split()) == 7001


def test_rows_of_any_kind(spark, odd, none):  # noqa: F811
    docs = odd.withColumn("runs", F.lit("mine")).withColumn("Collapsed", F.lit("yours"))
    out = periodicity.with_runs(docs)
    assert out.columns == [*docs.columns, "_runs", "_collapsed"]
    rows = out.collect()
    assert len(rows) == odd.count() and all((r["runs"], r["Collapsed"]) == ("mine", "yours") for r in rows)
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert r["_collapsed"] == " ".join(brute_kept(words, [tuple(x) for x in r["_runs"]]))
        if len(words) < 1000:
            assert [tuple(x) for x in r["_runs"]] == brute_runs(words)
    assert periodicity.with_runs(none).collect() == []


def test_query(spark):
    got = sorted(tuple(r) for r in queries.queries()["op12_periodic_runs"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(brute_row(*d) for d in docs)
