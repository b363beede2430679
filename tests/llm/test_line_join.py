"""Rows that the join of lines makes, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from sparkforest.llm import line_dedup


def test_a_run_of_common_tokens_makes_one_row(spark):
    rng, sets = np.random.default_rng(21), []
    base = sorted(rng.choice(1 << 20, 40, replace=False).tolist())
    for _ in range(30):
        own = set(base)
        for t in rng.choice(base, rng.integers(0, 6), replace=False).tolist():
            own.remove(t)
            own.add(int(rng.integers(1 << 20)))
        sets.append(sorted(own))
    rows = [(c, len(t), True, [(x << 32) + x % 977 for x in t]) for c, t in enumerate(sets)]
    df = spark.createDataFrame(rows, "c long, n int, open boolean, t array<long>")
    df = df.select("c", "n", "open", line_dedup.double_bitmap(F.col("t")).alias("bitmap"), line_dedup.prefix(F.col("t"), F.col("n"), 0.8).alias("prefix"))
    near = {(i, k) for k in range(30) for i in range(k) if 10 * len({*sets[i]} & {*sets[k]}) >= 8 * len({*sets[i]} | {*sets[k]})}
    for often_from in (0, 128):
        found = [tuple(sorted(r)) for r in line_dedup.meetings(df, 80, often_from).collect()]
        assert len(near) > 100 and near <= set(found)
        assert {tuple(r) for r in line_dedup.candidates(df, 80, often_from).collect()} == set(found)
        assert len(found) < 2 * len(set(found))  # one for each common token of the prefixes would be four and more
