"""Words in repeated windows, against a plain count; the hashes may collide in any way."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkforest.llm.quality_rules import confirmed_repeats


def plain(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})


def test_repeats_of_words_whatever_the_hashes(spark):
    rng = np.random.default_rng(3)
    rows = [([f"w{k}" for k in rng.integers(0, rng.integers(1, 6), rng.integers(0, 40))],) for _ in range(150)]
    df = spark.createDataFrame(rows, "w array<string>")
    for many in (1 << 40, 2):  # two hashes for all words: nearly all windows share one
        out = df.select("w", confirmed_repeats(F.col("w"), F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(many)))).alias("n")).collect()
        assert [r["n"] for r in out] == [plain(r["w"]) for r in out] and any(r["n"] for r in out)
