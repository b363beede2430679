"""Transitions of keys between live and stale, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def merged(stretches: list[tuple[int, int, bool]], timeout: int) -> list[tuple[int, int, bool]]:
    """Stretches (first event, last event, told) in order, where those less than ``timeout`` apart are one."""
    out: list[tuple[int, int, bool]] = []
    for first, last, told in sorted(stretches):
        if out and first - out[-1][1] < timeout:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] or told)
        else:
            out.append((first, last, told))
    return out


def stretches_of(times: np.ndarray, timeout: int) -> list[tuple[int, int, bool]]:
    """Stretches of event times, so that a key with many events in a batch keeps a few numbers of them."""
    times = np.sort(times)
    cut = np.flatnonzero(np.diff(times) >= timeout)
    return [(int(times[a]), int(times[b]), False) for a, b in zip(np.append(0, cut + 1), np.append(cut, len(times) - 1))] if len(times) else []


def step(state: tuple, found: list[tuple[int, int, bool]], passed: int, timeout: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, bool]]]:
    """Transitions to tell at the watermark ``passed``, and the stretches to keep: those whose end it hasn't passed."""
    out, kept = [], []
    for start, end, known in merged([*zip(*state), *found], timeout):
        if start <= passed and not known:  # no event before it can come any more
            out.append((start, "live"))
            known = True
        if end + timeout <= passed:
            out.append((end + timeout, "stale"))
        else:
            kept.append((start, end, known))
    return out, kept


def stepper(timeout: int):
    """For applyInPandasWithState: a key's rows, or its timer, and its stretches; times are microseconds."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed, found = state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            for b in rows:
                times = b["_us"].to_numpy(np.int64)
                found += stretches_of(times[times >= passed], timeout)  # later ones have been told otherwise
        out, kept = step(state.get if state.exists else ([], [], []), found, passed, timeout)
        if kept:
            state.update(tuple(map(list, zip(*kept))))
            due = -(-min(end + timeout if known else start for start, end, known in kept) // 1000)
            state.setTimeoutTimestamp(due - 1)  # timers go off once the watermark is past their time, at ``due``
        elif state.exists:
            state.remove()
        if out:
            at, told = zip(*out)
            yield pd.DataFrame({"_name": np.full(len(at), key[0], object), "_us": np.array(at, np.int64), "state": np.array(told, object)})

    return run


def liveness_transitions(stream: DataFrame, key: str, ts: str, timeout: str = "15 seconds", late: str = "0 seconds") -> DataFrame:
    """(key, at, state): a key is ``live`` from its first event, and ``stale`` once it has been silent for ``timeout``.

    Each key has a timer of its own: it turns stale when the watermark passes that time, whatever other keys do, and live
    again on its return. Events up to ``late`` behind may come in any order; later ones are dropped. The state of a key is
    its open stretches, however many events these have. States come and go with the rows, many keys to an Arrow batch:
    nothing is asked for key by key. The session is set to the RocksDB state store, so that states needn't fit in memory.
    A null key is a key; keys are compared as strings.
    """
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    micros = int(spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {timeout})").first()[0])
    # Keys go as strings, since pandas would make numbers of other kinds of a column with a null, and times as numbers, which
    # no time zone moves. Each column costs time for each key.
    events = stream.select(F.col(key).cast("string").alias("_name"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    groups = events.withColumn("_us", F.unix_micros("_ts")).groupBy("_name")
    told = groups.applyInPandasWithState(stepper(micros), "_name string, _us bigint, state string", "first array<bigint>, last array<bigint>, told array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("_name").cast(stream.schema[key].dataType).alias(key), F.timestamp_micros("_us").alias("at"), "state")
