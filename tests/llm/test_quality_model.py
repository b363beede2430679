"""The model of quality is of all labelled rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkforest.llm import quality_model


def test_the_threshold_is_a_rank_among_all_labelled_rows(spark):
    """Of more rows of each label than a former bound of 10,000."""
    rng, words = random.Random(3), ["a", "Bee", "see##", "dee!", "9", "x|y", "GEE", "aitch,"]
    texts = [" ".join(rng.choices(words[: 4 + 4 * (k % 2)], k=rng.randrange(1, 12))) for k in range(400)]
    n = 21_000
    rows = [(k, texts[rng.randrange(400)], int(k % 3 > 0 and k % 2)) for k in range(n)] + [(n, None, 0), (n + 1, "", 1), (n + 2, "left out", None), (None, "left out", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights, threshold = quality_model.fit(docs)
    shape = {t: np.array(quality_model.features(t)) @ weights for t in {r[1] or "" for r in rows}}
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    raw, low = sorted(shape[r[1] or ""] for r in known), sum(r[2] == 0 for r in known)
    assert min(low, len(known) - low) > 6000 and threshold == pytest.approx((raw[low - 1] + raw[low]) / 2, abs=1e-9)


def test_every_labelled_row_is_in_a_pair(spark):
    rows = spark.range(70).select((F.col("id") % 14 > 0).cast("int").alias("_y"), F.col("id").alias("_k"), F.array(F.col("id").cast("double")).alias("features"))
    rows, counts = quality_model.numbered(rows.unionAll(rows.where("_k = 3")))
    assert counts == {0: 5, 1: 66}
    found = rows.collect()
    for y, n in counts.items():
        assert sorted(r["_n"] for r in found if r["_y"] == y) == list(range(1, n + 1))
    own = {(r["_y"], r["_n"]): r["features"][0] for r in found}
    pairs = quality_model.preferences(rows, counts).collect()
    assert {r["_good"] for r in pairs} == set(range(1, 67)) and all(sum(r["_bad"] == b for r in pairs) >= 4 for b in range(1, 6))
    assert all(r["d"] == [(own[1, r["_good"]] - own[0, r["_bad"]]) * (1 if r["won"] else -1)] for r in pairs)
