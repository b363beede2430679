"""Transitions by timers against the plain rule, with unordered files, late events and keys that come back."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkforest.streaming import liveness

START = dt.datetime(2024, 1, 1)


def plain(events, timeout):
    """(key, seconds, state) of all events at once."""
    out = []
    for key in {k for k, _ in events}:
        last = None
        for t in sorted(t for k, t in events if k == key):
            if last is None or t - last >= timeout:
                if last is not None:
                    out.append((key, last + timeout, "stale"))
                out.append((key, t, "live"))
            last = t
        out.append((key, last + timeout, "stale"))
    return sorted(out)


def test_stretches():
    assert liveness.stretches_of(np.array([9, 1, 3, 20]), 6) == [(1, 3, False), (9, 9, False), (20, 20, False)] and liveness.stretches_of(np.array([], int), 5) == []
    assert liveness.merged([(10, 12, False), (1, 4, True), (8, 9, False)], 5) == [(1, 12, True)] and liveness.merged([(1, 4, True), (9, 9, False)], 5) == [(1, 4, True), (9, 9, False)]


@pytest.fixture
def run(spark, tmp_path):
    def run(batches, late, path):
        """Transitions after each batch; a batch is a file of (key, seconds)."""
        told, seen = [], []
        stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
        for i, b in enumerate(batches):
            rows = [(k, START + dt.timedelta(seconds=s)) for k, s in b]
            spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(f"{path}/in/{i:02d}")
            if not i:
                out = liveness.liveness_transitions(stream, "k", "t", "15 seconds", late)
                query = out.select("k", (F.unix_micros("at") / 1e6).alias("s"), "state").writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, n: told.extend(map(tuple, df.collect()))).start()
            query.processAllAvailable()
            seen.append(sorted((k, round(s - START.replace(tzinfo=dt.timezone.utc).timestamp(), 6), x) for k, s, x in told))
        query.stop()
        return seen

    return run


def test_a_key_turns_stale_by_its_own_timer_and_comes_back(run, tmp_path):
    seen = run([[("a", 0), ("b", 0)], [("b", 10)], [("b", 16)], [("b", 20), ("a", 21)], [("b", 34)], [("z", 1000)]], "0 seconds", tmp_path)
    assert ("a", 15.0, "stale") in seen[2] and not any(s == "stale" for k, _, s in seen[2] if k == "b")
    assert [x for x in seen[-1] if x[0] != "z"] == plain([("a", 0), ("b", 0), ("b", 10), ("b", 16), ("b", 20), ("a", 21), ("b", 34)], 15)


def test_unordered_events_give_what_all_at_once_give(run, tmp_path):
    rng = random.Random(5)
    events = [(rng.choice("abc"), rng.randrange(0, 4000) / 10) for _ in range(120)]
    near = sorted(events, key=lambda e: e[1] + rng.random() * 50)  # up to 50 seconds behind
    batches = [near[i : i + 20] for i in range(0, 120, 20)]
    seen = run([*batches, [("z", 5000)]], "60 seconds", tmp_path)
    assert [x for x in seen[-1] if x[0] != "z"] == [(k, round(t, 6), x) for k, t, x in plain(events, 15)]


def test_what_comes_too_late_changes_nothing(run, tmp_path):
    seen = run([[("a", 0)], [("b", 100)], [("a", 5)], [("z", 1000)]], "0 seconds", tmp_path)
    assert [x for x in seen[-1] if x[0] == "a"] == [("a", 0.0, "live"), ("a", 15.0, "stale")]


def test_a_night_with_an_hour_twice_and_keys_that_are_null_or_empty(spark, tmp_path):
    begin = round((dt.datetime(2024, 10, 26, 23, 30) - START).total_seconds())
    events = [(k, begin + 900 * i) for i in (0, 1, 4, 5, 8, 9) for k in ("null", "", "a")]
    zero = round(START.replace(tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(k, zero + s) for k, s in [*events, ("z", begin + 100_000)]], "k string, s long").select(F.expr("nullif(k, 'null')").alias("k"), F.timestamp_seconds("s").alias("t"))
    df.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        out = liveness.liveness_transitions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "t", "20 minutes")
        path = f"{tmp_path}/out"
        out.select(F.coalesce("k", F.lit("null")).alias("k"), (F.unix_micros("at") / 1e6 - zero).alias("s"), "state").writeStream.option("path", path).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["k"], round(r["s"], 6), r["state"]) for r in spark.read.parquet(path).collect() if r["k"] != "z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == plain(events, 1200) and len(got) == 18
