"""Near-duplicate documents: SetSketch registers, banded; a joint likelihood estimate; exact verification; components.

A document's set holds its distinct word shingles. Sets that are equal form a class; only class
representatives are compared. Within a band's bucket, rows are compared with the bucket's hub, and then only rows
that are still in different components, in blocks from which only links come out, so a large group doesn't become
all of its pairs, while no link that joins components is lost. Every link is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, free, small_batches

#: 40 bands of 6 registers: a pair at Jaccard 0.8 shares no band with probability 5e-6, at 0.9 below 1e-13.
BANDS, ROWS = 40, 6
#: SetSketch: register = floor(1 - log_base(smallest exponential / RATE)), truncated to [0, TOP].
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Pairs whose estimate is more than this below the threshold aren't verified: over 7 standard errors.
SLACK = 0.2
#: Rows and bytes of text of a block, of which a task holds two at once.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 23
#: Bytes of texts that are hashed at once, and words whose hashes a worker keeps.
BLOCK, KEEP_WORDS = 1 << 20, 200_000

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _U(_STEP)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64 bits of BLAKE2b of each word, worked out when a word is first seen."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def words_of(text: str) -> list[bytes]:
    """Runs of bytes that aren't ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each whole text, its sorted distinct shingle hashes: A-Z lower-cased, ``width`` words. With fewer
    words, the whole sequence is one; without words there is none."""
    known, at = _WordHashes(), 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(texts[at]) <= BLOCK):
            size += len(texts[at])
            held.append(words_of(texts[at]))
            at += 1
        if len(known) > KEEP_WORDS:
            known = _WordHashes()
        counts = [len(w) for w in held]
        hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(held)), np.uint64, sum(counts))
        run = _mix(hashes)
        for k in range(1, width):
            if len(hashes) > k:
                run = _mix(run[:-1] * _U(_STEP) + hashes[k:])
        lo = 0
        for n in counts:
            if n >= width:
                yield np.unique(run[lo : lo + n - width + 1])
            elif n:
                x = _mix(hashes[lo : lo + 1])
                for k in range(lo + 1, lo + n):
                    x = _mix(x * _U(_STEP) + hashes[k : k + 1])
                yield _mix(x + _U(n))
            else:
                yield np.empty(0, np.uint64)
            lo += n


class ExactSets:
    """Shingle sets of a few texts by the words themselves: equal numbers stand for equal shingles, without hashes."""

    def __init__(self, texts: list[str], width: int):
        number: dict[bytes, int] = {}
        counts, ids = [], []
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            ids.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)))
        seq = np.concatenate([*ids, np.empty(0, np.int64)])
        run, of = seq, len(number)
        for k in range(1, width):  # a pair of numbers becomes one again at each step
            pairs, run = np.unique(run[: max(0, len(seq) - k)] * (len(number) + 1) + seq[k:], return_inverse=True)
            of = max(of, len(pairs))
        short: dict[bytes, int] = {}
        self.sets, lo = [], 0
        for n in counts:
            if n >= width:
                self.sets.append(np.unique(run[lo : lo + n - width + 1]))
            else:
                self.sets.append(np.array([of + short.setdefault(seq[lo : lo + n].tobytes(), len(short))] if n else [], np.int64))
            lo += n
        self.size = of + len(short)

    def overlaps(self, one: int, others: list[int]) -> np.ndarray:
        """How many shingles a text shares with each of some others, none of which is empty."""
        mark = np.zeros(self.size, bool)
        mark[self.sets[one]] = True
        lengths = np.array([len(self.sets[o]) for o in others])
        return np.add.reduceat(mark[np.concatenate([self.sets[o] for o in others])].astype(np.int64), np.cumsum(lengths) - lengths)


_rng = np.random.default_rng(20240817)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def registers(x: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes. Registers of a union are the maxima of registers."""
    most = np.zeros(BANDS * ROWS, np.uint64)
    for at in range(0, len(x), 128):
        y = x[at : at + 128, None] * _MULTIPLY  # the hashes are mixed already; a register's own line orders them anew
        y += _ADD
        np.maximum(most, y.max(axis=0), out=most)
    uniform = (most.astype(np.float64) + 1) / 2.0**64  # the largest uniform is the smallest exponential
    least = -np.log(np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _likelihood(higher: np.ndarray, lower: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Logarithm of the joint likelihood of two sketches at Jaccard similarity ``j``; ``u`` and ``v`` are the shares
    of the two cardinalities in their sum. It is concave in ``j``."""
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
    return higher * np.log(np.maximum(up, 1e-12)) + lower * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def _compare(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, ...]:
    higher, lower = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return higher, lower, a.shape[1] - higher - lower, n_a / (n_a + n_b), n_b / (n_a + n_b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers by maximum likelihood, given the cardinalities."""
    seen = _compare(a, b, n_a, n_b)
    u, v = seen[3:]
    lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(24):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = _likelihood(*seen, x) > _likelihood(*seen, y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def estimate_reaches(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the joint estimate is at least ``least``: the likelihood still rises there, or the largest similarity
    that the cardinalities allow is the estimate. One step instead of a search."""
    seen = _compare(a, b, n_a, n_b)
    most = np.minimum(seen[3] / seen[4], seen[4] / seen[3])
    j, step = np.full(len(most), least), 1e-6
    return (most >= least) & (_likelihood(*seen, j + step) >= _likelihood(*seen, j - step))


def band_hashes(r: np.ndarray) -> np.ndarray:
    """The buckets of rows of registers, one for each band; the band takes part in the hash."""
    parts = r.reshape(len(r), BANDS, ROWS).astype(np.uint64)
    out = _mix(parts[:, :, 0] + _mix(np.arange(BANDS, dtype=np.uint64)))
    for k in range(1, ROWS):
        out = _mix(out * _U(_STEP) + parts[:, :, k])
    return out.view(np.int64)


def sketch(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, n_shingles, set_hash, bands, registers) of each whole text; sets without shingles have no bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, whole, regs = [], [], []
            for x in shingle_sets(b["_t"].tolist(), width):
                n.append(len(x))
                whole.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b"")
                regs.append(registers(x) if len(x) else np.zeros(BANDS * ROWS, np.uint16))
            if n:
                bands = band_hashes(np.stack(regs))
                has = [k > 0 for k in n]
                yield pd.DataFrame({"id": b["_k"], "digest": b["_d"], "n_shingles": n, "set_hash": whole, "bands": [x if y else None for x, y in zip(bands, has)], "registers": [x.tobytes() if y else None for x, y in zip(regs, has)]})

    few = small_batches(docs).select(F.col(key).cast("long").alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    few = few.withColumn("_d", F.unhex(F.md5("_t")))
    return few.mapInPandas(run, "id long, digest binary, n_shingles long, set_hash binary, bands array<long>, registers binary")


def similar(one: int, others: list[int], sets: ExactSets, similarity: int) -> np.ndarray:
    """Whether 100 * intersection >= ``similarity`` * union, for a text and some others of ``sets``."""
    both = sets.overlaps(one, others)
    union = len(sets.sets[one]) + np.array([len(sets.sets[o]) for o in others]) - both
    return 100 * both >= similarity * union


def confirmed(pairs: DataFrame, members: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of ``members`` (c, n, r, text) whose estimate isn't far below ``similarity`` and whose full
    shingle sets, compared by their words, reach it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            ra, rb = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), -1) for c in ("ra", "rb"))
            p = p[estimate_reaches(ra, rb, p["na"].to_numpy(float), p["nb"].to_numpy(float), similarity / 100 - SLACK)]
            for a, g in p.groupby("a"):
                at, own = 0, g["ta"].iat[0]
                while at < len(g):
                    end, size = at, len(own)
                    while end < len(g) and (end == at or size + len(g["tb"].iat[end]) <= BLOCK):
                        size, end = size + len(g["tb"].iat[end]), end + 1
                    sets = ExactSets([own, *g["tb"].iloc[at:end]], width)
                    near = similar(0, list(range(1, end - at + 1)), sets, similarity)
                    yield pd.DataFrame({"a": a, "b": g["b"].to_numpy()[at:end][near]})
                    at = end

    side = lambda x: members.select(*[F.col(c).alias(f"{d}{x}" if d else x) for c, d in (("c", ""), ("n", "n"), ("r", "r"), ("text", "t"))])
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    return both.mapInPandas(run, "a long, b long")


def links_of_block(bucket: int, across: bool, c: np.ndarray, comp: np.ndarray, n: np.ndarray, x: np.ndarray, r: np.ndarray, texts: list[str], width: int, similarity: int) -> list[tuple[int, int]]:
    """Links that join different components among the rows of a block of a bucket (``across``: of two blocks).

    A pair that shares several buckets is compared in the first of them. Rows of the largest component aren't
    compared with each other. Estimates come first, then the full sets of what is left.
    """
    order = np.argsort(c)
    c, comp, n, x, r = c[order], comp[order], n[order], x[order], r[order]
    names, comp = np.unique(comp, return_inverse=True)
    apart = comp != np.bincount(comp).argmax()
    bands, maybe = band_hashes(r), []
    for k in np.flatnonzero(apart).tolist():
        fits = (comp != comp[k]) & ~(apart & (np.arange(len(c)) < k)) & (100 * np.minimum(n, n[k]) >= similarity * np.maximum(n, n[k]))
        if across:
            fits &= x != x[k]
        at = np.flatnonzero(fits)
        same = bands[at] == bands[k]
        at = at[bands[k][same.argmax(axis=1)] == bucket]
        if len(at):
            good = estimate_reaches(np.broadcast_to(r[k], (len(at), r.shape[1])), r[at], np.full(len(at), float(n[k])), n[at].astype(float), similarity / 100 - SLACK)
            maybe.append((k, at[good].tolist()))
    needed = sorted({k for k, o in maybe if o} | {i for _, o in maybe for i in o})
    if not needed:
        return []
    place = {i: p for p, i in enumerate(needed)}
    sets, root, found = ExactSets([texts[order[i]] for i in needed], width), list(range(len(names))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, others in maybe:
        others = [o for o in others if top(comp[o]) != top(comp[k])]
        if others:
            for o in np.array(others)[similar(place[k], [place[o] for o in others], sets, similarity)].tolist():
                if top(comp[o]) != top(comp[k]):
                    root[top(comp[o])] = top(comp[k])
                    found.append((int(c[k]), int(c[o])))
    return found


def compared(mixed: DataFrame, members: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links (a, b) that join components of rows (bucket, c, comp) of buckets that hold several of them.

    A bucket's rows are dealt into blocks by hash, and two blocks meet in one task, so that neither a bucket nor
    its pairs are gathered: rows grow with the blocks of a bucket, of which most have one, and only links come out.
    """

    def run(t: pa.Table) -> pa.Table:
        col = lambda name: t.column(name).to_numpy()
        r = np.frombuffer(b"".join(t.column("r").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        found = links_of_block(t.column("bucket")[0].as_py(), across, col("c"), col("comp"), col("n"), col("x"), r, t.column("text").to_pylist(), width, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    sized = mixed.join(members.select("c", F.octet_length("text").alias("bytes")), "c").groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("long")
    dealt = mixed.join(sized.select("bucket", blocks.alias("of")), "bucket").withColumn("x", F.pmod(F.xxhash64("c"), "of"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    dealt = dealt.select("bucket", "c", "comp", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return dealt.join(members, "c").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of the edges (a, b) reaches.

    Alternating large-star and small-star rounds on the edge table, so no group is gathered in one task.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    held = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # Large star: larger neighbours to the smallest neighbour.
        e = both(held)
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.store(large)
        # Small star: smaller neighbours, and the node, to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.store(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(held)
        scratch.drop(large)
        held = new
        if now == seen:
            return held.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = now


def _linked(docs: DataFrame, width: int, similarity: int, key: str, text: str) -> DataFrame:
    """(id, digest of the text, n_shingles, group, component_id) of each row; null group and component: linked with
    nothing."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.store(sketch(docs, width, key, text))
    filled = made.where("n_shingles > 0 and id is not null")
    # Rows of equal sets are one class; rows are told apart by key and text, as keys may repeat with other texts.
    same = filled.groupBy("set_hash").agg(F.min(F.struct("id", "digest")).alias("rep"), F.first("bands").alias("bands"), F.first("registers").alias("r"), F.first("n_shingles").alias("n"))
    classes = scratch.store(same.withColumn("c", F.monotonically_increasing_id()))
    rows = scratch.store(made.select("id", "digest", "n_shingles", "set_hash"))
    scratch.drop(made)
    # Rows of buckets that hold several classes. A bucket is counted, never gathered.
    buckets = classes.select("c", F.explode("bands").alias("bucket"))
    shared = scratch.store(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "bucket"))
    few = shared.select("c").distinct().join(classes.select("c", "rep", "n", "r"), "c")
    few = few.select("c", "n", "r", F.col("rep.id").alias("_k"), F.col("rep.digest").alias("_d"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_k"), F.col(text).alias("text"))
    members = scratch.store(texts.join(few, "_k").where(F.unhex(F.md5("text")) == F.col("_d")).select("c", "n", "r", "text").dropDuplicates(["c"]))
    # The hub of a bucket is its row of most and largest buckets: the text that the others are most alike to.
    weight = shared.groupBy("c").agg(F.sum("m").alias("w"))
    hubs = shared.join(weight, "c").groupBy("bucket").agg(F.max(F.struct("w", "c")).alias("h")).select("bucket", F.col("h.c").alias("hub"))
    pairs = shared.join(hubs, "bucket").where("c <> hub").select(F.least("c", "hub").alias("b"), F.greatest("c", "hub").alias("a")).distinct()
    edges = scratch.store(confirmed(pairs, members, width, similarity))
    found = components(scratch, edges)
    label = shared.join(found, F.col("c") == F.col("id"), "left").select("bucket", "c", F.coalesce("component", "c").alias("comp"))
    split = label.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    mixed = scratch.store(label.join(split, "bucket", "left_semi"))
    more = scratch.store(compared(mixed, members, width, similarity))
    if not more.isEmpty():
        found = components(scratch, edges.unionByName(more))
    scratch.drop(members)
    scratch.drop(mixed)
    group = classes.select("set_hash", "c", F.col("rep.id").alias("first")).join(found, F.col("c") == F.col("id"), "left").select("set_hash", "first", F.coalesce("component", "c").alias("group"))
    least = group.groupBy("group").agg(F.min("first").alias("component_id"))
    to = scratch.store(group.join(least, "group").select("set_hash", "group", "component_id"))
    known = rows.where("n_shingles > 0 and id is not null").join(to, "set_hash").select("id", "digest", "n_shingles", "group", "component_id")
    rest = rows.where("not (n_shingles > 0 and id is not null)")
    return known.unionByName(rest.select("id", "digest", "n_shingles", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component_id")))


def link(docs: DataFrame, width: int = 5, similarity: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``; keys are integers.

    Documents are linked from ``similarity`` percent of Jaccard on; ``component_id`` is the smallest key
    reachable, and rows that have it are kept. Null and empty texts and texts without words are linked with
    nothing. Rows that repeat a key are documents of their own, each with its own text; those of one component
    with the smallest key are all kept. No documents: no rows. Null keys stand alone.
    """
    out = _linked(docs, width, similarity, key, text).withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest key, then of the smallest digest
    of its text; of rows that repeat both, one. Rows that are linked with nothing stay, null keys and texts among them.
    """
    scratch, columns = Scratch(docs.sparkSession), docs.columns
    id, digest, row = (free(f"_{c}", columns) for c in ("id", "digest", "row"))
    rows = scratch.store(_linked(docs, width, similarity, key, text).where("group is not null"))
    first = rows.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("first"))
    each = rows.groupBy("group", "id", "digest").agg(F.count("*").alias("times")).join(first, "group").withColumn("stays", F.struct("id", "digest") == F.col("first"))
    each = scratch.store(each.where("not stays or times > 1").select(F.col("id").alias(id), F.col("digest").alias(digest), "stays"))
    here = lambda t: (docs[key].cast("long") == t[id]) & (F.unhex(F.md5(docs[text])) == t[digest])
    out = docs.join(each, here(each), "left_anti")
    repeated = each.where("stays").drop("stays")
    if repeated.isEmpty():
        return out
    all_columns = [F.col(f"`{c}`") for c in columns]
    own = docs.join(repeated, here(repeated)).groupBy(id, digest).agg(F.min_by(F.struct(*all_columns), F.xxhash64(*all_columns)).alias(row))
    return out.unionByName(own.select(f"{row}.*"))


def op5_setsketch(spark, sf_dir: str) -> DataFrame:
    """``link`` over all of ``documents`` with 4-word shingles. Null and empty texts: no shingles, kept."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
