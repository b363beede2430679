"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import first_by_hash, free, small_batches

#: N-grams in a profile, of a language or a document.
PROFILE = 300
#: Documents of a language that profiles are learnt from, at most (a bounded sample by hash order).
SAMPLE = 2000
UNKNOWN = "und"
#: Sharpness of the score: how fast it falls with the distance lead of another language.
SHARPNESS = 25.0
_BITS, _MARK = 21, 32
#: Characters that are counted at once.
BLOCK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    out = np.full(0x110000, _MARK, np.int64)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i
    return out


def added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two tables of counts."""
    if not len(codes):
        return more, n
    both, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)


def ngram_counts(text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all 1-, 2- and 3-grams within words of letters, a space standing for a word's edges.

    The whole text counts; it goes through in blocks, whose counts are added.
    """
    low, held = text.lower(), np.array([_MARK], np.int64)
    codes = counts = np.empty(0, np.int64)
    for at in range(0, len(low) + 1, block):
        part = low[at : at + block] + (" " if at + block > len(low) else "")
        new = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        a, n = np.concatenate([held, new]), len(held)  # ``held``: the last two symbols of what came before
        keep = np.ones(len(a), bool)
        keep[n:] = (a[n:] != _MARK) | (a[n - 1 : -1] != _MARK)
        a = a[keep]
        letter, late = a != _MARK, max(0, n - 2)
        two = (a[:-1] << _BITS) | a[1:]
        three = ((two[:-1] << _BITS) | a[2:])[late:][letter[1:-1][late:]]
        codes, counts = added(codes, counts, *np.unique(np.concatenate([a[n:][letter[n:]], two[n - 1 :], three]), return_counts=True))
        held = a[-2:]
    return codes, counts


def top(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, most frequent first; of equal counts, the smaller code first."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:n]


def learn_profiles(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """Language profiles from at most ``sample`` rows of each language, taken by the order of a hash of ``key``.

    Rows with null language, text or key teach nothing; of rows that repeat a key, each teaches. The result is the model: ``size`` codes for a language.
    """
    named = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    named = small_batches(named).select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
    # At most ``sample`` rows a language, whatever the input; the texts of these alone are read further.
    chosen = first_by_hash(named, "_l", "_k", sample).select("_k", "_l").distinct()
    texts = named.join(F.broadcast(chosen), ["_k", "_l"], "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, np.int64)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for name, t in zip(b["_l"], b["_t"]):
                sums[name] = added(*sums.get(name, (none, none)), *ngram_counts(t))
        for name, (codes, counts) in sums.items():
            yield pd.DataFrame({"lang": name, "code": codes, "n": counts})

    summed = texts.select("_l", "_t").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = summed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names])) if self.names else np.empty(0, np.int64)
        self.rank = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for i, n in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, np.array(profiles[n], np.int64))] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text) if text else ((), ())
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where(self.codes[at] == own, self.rank[:, at], -1)
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))))
        distance = apart.sum(axis=1) / (self.size * len(own))
        weight = np.exp(-SHARPNESS * (distance - distance.min()))
        i = int(distance.argmin())  # of equal distances, the first name
        return self.names[i], float(weight[i] / weight.sum())


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to each row, from its whole text alone.

    ``und`` with score 0: null or empty text, or no letter in it. Of equal distances, the first name in order.
    Other columns stay, but for clashing names, which are replaced. Nothing is shuffled.
    """

    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(profiles)
        for s in values:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score"])

    # Marked so that a filter on the result doesn't make the plan run it twice.
    guess = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(F.coalesce(text, F.lit("")))
    g = free("_guess", docs.columns)
    return small_batches(docs).withColumn(g, guess).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")], F.col(f"{g}.lang_pred").alias("lang_pred"), F.col(f"{g}.score").alias("score"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    profiles = learn_profiles(docs.where(~held_out))
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
