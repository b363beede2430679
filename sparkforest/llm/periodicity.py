"""Periodic runs of words, exactly: a run-length grammar by recompression answers extension queries.

A slice of texts becomes one sequence of word numbers with a separator of its own before, between and after the
texts. Recompression alternates two steps until no letter occurs twice: blocks of one letter become a letter, then
letters are dealt to two sides and each pair left-right becomes a letter. Equal letters of a level stand for equal
words, and both steps look at neighbours only, so two places are compared by climbing the levels while they agree and
coming down where they part: a few steps of numpy on all queries of a slice at once, and as many levels as the
logarithm of what is common.

A run of period q covers a multiple of q together with the place q further on. Such places that hold equal words are
the candidates; how far they agree backwards and forwards is the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkforest.llm._util import WORD_BREAK, free, small_batches
from sparkforest.llm.quality_rules import let

#: A run has at least so many words, and two periods.
LEAST_LENGTH = 12
#: Characters of texts that share a grammar; a longer text has one of its own.
SLICE = 3_000_000
#: Candidates that are extended at once.
AT_ONCE = 1_000_000

RUN = ("start", "length", "period")


class Grammar:
    """Levels of a sequence whose first and last letters occur once. ``letters[h]`` are those of level h; letter k of
    level h + 1 stands for the letters from ``first[h][k]`` up to ``first[h][k + 1]`` of level h."""

    def __init__(self, sequence: np.ndarray):
        self.letters, self.first, self.parent, self.blocks = [sequence.astype(np.int32)], [], [], []
        names, turn = int(sequence.max()) + 1, 0
        while True:
            row = self.letters[-1]
            if len(row) < 2 or np.bincount(row, minlength=1).max() < 2:
                return
            same = row[1:] == row[:-1]
            if same.any():
                names = self._blocks(row, same, names)
                row = self.letters[-1]
            names, turn = self._pairs(row, names, turn), turn + 1

    def _step(self, starts: np.ndarray, letters: np.ndarray, blocks: bool) -> None:
        self.first.append(np.append(np.flatnonzero(starts), len(starts)).astype(np.int32))
        self.parent.append((np.cumsum(starts) - 1).astype(np.int32))
        self.letters.append(letters)
        self.blocks.append(blocks)

    def _blocks(self, row: np.ndarray, same: np.ndarray, names: int) -> int:
        starts = np.append(True, ~same)
        at = np.flatnonzero(starts)
        size = np.diff(np.append(at, len(row)))
        letters = row[at].copy()
        long = size > 1
        code, known = pd.factorize(letters[long].astype(np.int64) * (int(size.max()) + 1) + size[long])
        letters[long] = names + code
        self._step(starts, letters, True)
        return names + len(known)

    def _pairs(self, row: np.ndarray, names: int, turn: int) -> int:
        """Sides by a hash of the letter and the turn; of the two orders of sides the one with more pairs."""
        mixed = (row.astype(np.uint32) + np.uint32(turn * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        right = (mixed >> np.uint32(17)) & np.uint32(1) == 1
        ahead, back = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        at = np.flatnonzero(ahead if np.count_nonzero(ahead) >= np.count_nonzero(back) else back)
        if not len(at):
            return names
        code, known = pd.factorize((row[at].astype(np.int64) << 32) | row[at + 1].astype(np.int64))
        joined = row.copy()
        joined[at] = names + code
        starts = np.ones(len(row), bool)
        starts[at + 1] = False
        self._step(starts, joined[starts], False)
        return names + len(known)

    def common(self, x: np.ndarray, y: np.ndarray, ahead: bool) -> np.ndarray:
        """How many letters are equal from the places x and y (unlike ones) on, forwards or backwards."""
        begin, query = x, np.arange(len(x))
        parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sign = 1 if ahead else -1
        for h, row in enumerate(self.letters):
            # Up: what differs here parts; the rest goes to where a letter of the next level begins, and climbs.
            equal = row[x] == row[y]
            out = [(query[~equal], x[~equal], y[~equal])]
            if h < len(self.first):
                query, x, y = query[equal], x[equal], y[equal]
                px, py = self.parent[h][x], self.parent[h][y]
                left_x, left_y = self._left(h, x, px, ahead), self._left(h, y, py, ahead)
                whole = (left_x == self._size(h, px)) & (left_y == self._size(h, py))
                early = ~whole & (left_x != left_y)  # one block ends before the other
                if early.any():
                    go = sign * np.minimum(left_x, left_y)[early]
                    out.append((query[early], x[early] + go, y[early] + go))
                    query, px, py, whole = query[~early], px[~early], py[~early], whole[~early]
                step = np.where(whole, 0, sign)
                x, y = px + step, py + step
            parted.append(tuple(np.concatenate(c) for c in zip(*out)))
            if h == len(self.first) or not len(query):
                break
        query, x, y = parted[-1]
        for h in range(len(parted) - 2, -1, -1):
            # Down: to the first letters of the two, past the one they may share or the block that both begin with.
            x, y = (self.first[h][x], self.first[h][y]) if ahead else (self.first[h][x + 1] - 1, self.first[h][y + 1] - 1)
            equal = self.letters[h][x] == self.letters[h][y]
            if self.blocks[h]:
                go = np.minimum(self._left(h, x, self.parent[h][x], ahead), self._left(h, y, self.parent[h][y], ahead))
                go = sign * np.where(equal, go, 0)
            else:
                go = sign * equal.astype(np.int32)
            more = parted[h]
            query, x, y = np.concatenate([query, more[0]]), np.concatenate([x + go, more[1]]), np.concatenate([y + go, more[2]])
        found = np.empty(len(begin), np.int64)
        found[query] = (x - begin[query]) * sign
        return found

    def _left(self, h: int, x: np.ndarray, p: np.ndarray, ahead: bool) -> np.ndarray:
        """Letters of level h from x, itself included, to the end of its parent p."""
        return self.first[h][p + 1] - x if ahead else x - self.first[h][p] + 1

    def _size(self, h: int, p: np.ndarray) -> np.ndarray:
        return self.first[h][p + 1] - self.first[h][p]


def runs_of(sequence: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period. ``sequence`` holds texts, the longest first, between
    letters that occur once; text k has ``lengths[k]`` letters and ends before place ``ends[k]``."""
    if not len(lengths) or lengths[0] < least:
        return (np.empty(0, np.int64),) * 3
    grammar, row = Grammar(sequence), sequence
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, int, int]] = []

    def extend() -> None:
        i = np.concatenate([w[0] for w in waiting])
        q, grid = (np.repeat([w[k] for w in waiting], [len(w[0]) for w in waiting]) for k in (1, 2))
        back = grammar.common(i - 1, i + q - 1, False)
        new = back < grid  # the first place of the grid within the run
        i, q, grid, back = i[new], q[new], grid[new], back[new]
        on = grammar.common(i, i + q, True)
        whole = back + on >= grid
        found.append(((i - back)[whole], (i + q + on)[whole], q[whole]))
        waiting.clear()

    held = 0
    # Texts with at least two periods and the least length are a prefix of the sequence.
    for q in range(1, int(lengths[0]) // 2 + 1):
        grid = max(q, least - q)  # a run of the period holds so many places with their partners
        upto = int(ends[np.searchsorted(-lengths, -max(2 * q, least), side="right") - 1])
        at = np.flatnonzero(row[0 : upto - q : grid] == row[q:upto:grid]) * grid
        if len(at):
            # Of six places or more, one next to this one is equal too. Place 0 is a separator, so there is one before.
            at = at[(row[at + 1] == row[at + q + 1]) | (row[at - 1] == row[at + q - 1])]
            if len(at):
                waiting.append((at, q, grid))
                held += len(at)
        if held >= AT_ONCE:
            extend()
            held = 0
    if waiting:
        extend()
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, end, period = (np.concatenate(c) for c in zip(*found))
    # What has a period has its multiples too: of equal stretches the smallest period stays.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    own = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def collapse(texts: list[str], least: int = LEAST_LENGTH) -> tuple[list[list[dict]], list[str]]:
    """Runs of each text, and each text's words, joined by a space, without those that a run has after its first
    period. ``bytes.split`` takes just the white space of ASCII."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    runs: list[list[dict]] = [[] for _ in texts]
    kept = [None] * len(texts)
    order = sorted((k for k, w in enumerate(words) if len(w) >= least), key=lambda k: -len(words[k]))
    if order:
        lengths = np.array([len(words[k]) for k in order])
        coded = pa.array([w for k in order for w in words[k]], pa.large_binary()).dictionary_encode()
        codes, known = np.asarray(coded.indices), len(coded.dictionary)
        starts = np.cumsum(lengths + 1) - lengths
        sequence = np.empty(int(lengths.sum()) + len(order) + 1, np.int32)
        apart = np.append(0, starts + lengths)
        text = np.ones(len(sequence), bool)
        text[apart] = False
        sequence[apart], sequence[text] = known + np.arange(len(apart)), codes
        start, end, period = runs_of(sequence, starts + lengths, lengths, least)
        change = np.zeros(len(sequence) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        drop = np.cumsum(change) > 0
        of = np.searchsorted(starts, start, side="right") - 1
        for k, s, n, q in zip(of.tolist(), (start - starts[of]).tolist(), (end - start).tolist(), period.tolist()):
            runs[order[k]].append({"start": s, "length": n, "period": q})
        for k in np.unique(of).tolist():
            own = words[order[k]]
            kept[order[k]] = b" ".join([own[i] for i in np.flatnonzero(~drop[starts[k] : starts[k] + lengths[k]]).tolist()])
    return runs, [(b" ".join(w) if c is None else c).decode("utf-8", "surrogatepass") for w, c in zip(words, kept)]


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` with two more columns: ``runs``, all periodic runs of words (start, length, period; by start, then
    period), and ``collapsed``, the words joined by one space without those that repeat in a run.

    A run is a longest stretch in which words a period apart are equal, of at least ``least`` words and two of its
    smallest period. Rows, their number and their columns stay, repeated rows and null keys too; nothing is shuffled.
    Null and empty texts have no runs and an empty ``collapsed``. Columns of the two names that ``docs`` has already
    stay, and the new ones get underscores before their names. Memory is bounded by SLICE or the longest text.
    """
    runs, collapsed = free(runs, docs.columns), free(collapsed, docs.columns)
    place = docs.columns.index(text)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = [t or "" for t in b.column(place).to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                    size, end = size + len(texts[end]), end + 1
                found, left = collapse(texts[at:end], least)
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind), pa.array(left, pa.string())], names=[*b.schema.names, runs, collapsed])
                at = end

    spans = T.StructType([T.StructField(n, T.LongType()) for n in RUN])
    fields = [*docs.schema.fields, T.StructField(runs, T.ArrayType(spans)), T.StructField(collapsed, T.StringType())]
    return small_batches(docs).mapInArrow(run, T.StructType(fields))


def planted(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys its words with a stretch that repeats to the end; both by crc32 of the key."""
    hashed = F.crc32(key.cast("string"))
    ninth = F.floor(hashed / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(ninth, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(ninth, F.lit(8))))).cast("int")
        rest = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(rest, F.lit(1), n - a)), " ")

    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    return F.when(hashed % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(text))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all runs of ``documents`` after a tenth of the texts got a stretch that repeats, and of what is left
    without the repeats. Null and empty texts: no runs, digests of nothing. Repeated rows give repeated results."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_runs(docs.withColumn("text", planted(F.col("doc_id"), F.col("text"))))
    # The longest run; of equal ones the first, then that with the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
