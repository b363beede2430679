"""I-Match fingerprints: distinct terms of a middle inverse-document-frequency band, hashed by random lexicon subsets."""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Band of document frequencies, as shares of all documents: idf from ln(1/0.2) to ln(1/0.001).
LEAST, MOST = 0.001, 0.2
#: Level k splits the lexicon at random into CELLS * 4**k subsets and takes CELLS of them.
LEVELS, CELLS = 5, 24
#: Texts whose least hashes of terms, so many, are equal are copies of each other where common terms are counted.
COPY = 3
#: A text with fewer terms of the band is filled up to so many with other terms of its own.
FEW = 24
#: Terms that a task counts before it hands them on.
FLUSH = 300_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> set[bytes]:
    """Distinct terms: A-Z lower-cased, split at all ASCII characters but letters and digits."""
    return set(text.encode("utf-8", "surrogatepass").translate(_TERM).split())


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term binary, df) over all rows. Null texts have no terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["_t"]:
                held.update(terms(t))
                if len(held) > FLUSH:
                    yield pd.DataFrame({"term": list(held), "df": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"term": list(held), "df": list(held.values())})

    seen = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_t"))
    return seen.mapInPandas(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def copy_shares(docs: DataFrame, common: list[bytes], text: str = "text") -> list[float]:
    """The share of each term among all classes of copies, each of which counts as one of its members."""
    index = {t: i for i, t in enumerate(common)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        keys = frozenset(of)
        for b in batches:
            rows = []
            for t in b["_t"]:
                if found := terms(t):
                    has = np.zeros(len(of), bool)
                    has[[of[x] for x in found & keys]] = True
                    rows.append((np.array(sorted(map(zlib.crc32, found))[:COPY], ">u4").tobytes(), np.packbits(has).tobytes()))
            yield pd.DataFrame(rows, columns=["copy", "bits"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(common) + 1, np.int64)  # the last one counts the classes
        for b in batches:
            if len(b):
                n[:-1] += np.unpackbits(np.frombuffer(b"".join(b["bits"]), np.uint8).reshape(len(b), -1), axis=1, count=len(common)).sum(axis=0, dtype=np.int64)
                n[-1] += len(b)
        yield pd.DataFrame({"i": np.arange(len(n)), "n": n})

    seen = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_t"))
    classes = seen.mapInPandas(mark, "copy binary, bits binary").groupBy("copy").agg(F.max("bits").alias("bits"))
    sums = {r["i"]: r["n"] for r in classes.select("bits").mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [sums[i] / max(1, sums[len(common)]) for i in range(len(common))]


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> list[bytes]:
    """All terms of the band, highest document frequency first within the common and the other ones.

    However many documents there are, a band from ``least`` has at most 1 / ``least`` times the mean number of terms
    of a document, which bounds what is broadcast.

    A term of more than ``most`` of all rows still belongs to the band if copies make it so frequent: if it is in
    no more than ``most`` of the classes of copies. Such terms are few: they are at most 1 / ``most`` times the mean
    number of terms of a document.
    """
    n = docs.count()
    known = document_frequencies(docs, text).where(F.col("df") >= max(2, least * n))
    known = known.persist(StorageLevel.DISK_ONLY)
    often = F.col("df") > max(2, most * n)
    common = [bytes(r[0]) for r in known.where(often).orderBy(F.desc("df"), "term").select("term").collect()]
    copied = [t for t, share in zip(common, copy_shares(docs, common, text)) if share <= most] if common else []
    band = [bytes(r[0]) for r in known.where(~often).orderBy(F.desc("df"), "term").select("term").collect()]
    known.unpersist()
    return copied + band


class IMatch:
    def __init__(self, lexicon: list[bytes]):
        raw = [hashlib.blake2b(t, digest_size=16).digest() for t in lexicon]
        self.code = {t: r[:8] for t, r in zip(lexicon, raw)}
        draw = np.array([int.from_bytes(r[8:], "little") for r in raw], np.uint64)
        cells: list[np.ndarray] = []
        for level in range(LEVELS):
            cell = (draw >> np.uint64(11 * level)) % np.uint64(CELLS * 4**level)
            cells.append(np.where(cell < CELLS, cell.astype(np.int64) + level * CELLS, -1))
        of = np.stack(cells, axis=1).tolist() if lexicon else []
        self.cells = {t: [c for c in x if c >= 0] for t, x in zip(lexicon, of)}

    def fingerprint(self, text: str) -> str:
        """Four hex digits for the terms of the whole band, then for each subset; 0000 where a text has none.

        A text with fewer than FEW terms of the band has other terms too, those of the least hashes, up to FEW, which
        fall in the same subsets; one without a term of the band is known by all its terms in the first digits.
        """
        all_terms = terms(text)
        found = sorted(t for t in all_terms if t in self.code)
        placed = [(self.code[t], self.cells[t]) for t in found]
        if len(found) < FEW:
            placed += sorted(_placed(t) for t in all_terms if t not in self.code)[: FEW - len(found)]
        groups: dict[int, list[bytes]] = {}
        for code, cells in placed:
            for c in cells:
                groups.setdefault(c, []).append(code)
        out = ["0000"] * (LEVELS * CELLS)
        for c, codes in groups.items():
            out[c] = _digest(sorted(codes))
        return _digest([self.code[t] for t in found] or [b"-", *sorted(all_terms)]) + "".join(out)


@functools.lru_cache(1 << 16)
def _placed(term: bytes) -> tuple[bytes, list[int]]:
    """Code and subsets of a term outside the lexicon, as the lexicon would have them."""
    raw = hashlib.blake2b(term, digest_size=16).digest()
    draw = int.from_bytes(raw[8:], "little")
    cells = [((draw >> (11 * k)) % (CELLS * 4**k), k) for k in range(LEVELS)]
    return raw[:8], [c + k * CELLS for c, k in cells if c < CELLS]


def _digest(parts: list[bytes]) -> str:
    x = int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=2).digest(), "big")
    return f"{x or 1:04x}"


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal subsets of those that either text has terms in.

    Taken from the level whose subsets hold about one term, the finest with enough subsets that aren't empty,
    and all finer ones.
    """
    if a == b:
        return 1.0
    x = np.frombuffer(bytes.fromhex(a), ">u2")[1:].reshape(LEVELS, CELLS)
    y = np.frombuffer(bytes.fromhex(b), ">u2")[1:].reshape(LEVELS, CELLS)
    either, same = ((x > 0) | (y > 0)).sum(axis=1), ((x == y) & (x > 0)).sum(axis=1)
    enough = np.flatnonzero(either >= CELLS // 2)
    level = enough[-1] if len(enough) else 0
    return float(same[level:].sum() / max(1, either[level:].sum()))


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many first ones of the following text (or all of it)."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _t, _bucket, _look): rows in buckets of falling keys. A bucket's rows are followed by a copy
    (``_look`` = 1) of the row that comes after them, which is the first one again after the last."""
    spark = docs.sparkSession
    few = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(few.stat.approxQuantile("_k", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else np.empty(0)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:  # nulls come last, as the smallest keys
        place = len(bounds) - np.searchsorted(bounds, keys.fillna(-np.inf).to_numpy(float), side="right")
        return pd.Series(place).where(keys.notna().to_numpy(), len(bounds) + 1).astype("int32")

    few = few.withColumn("_bucket", bucket(F.col("_k").cast("double")))
    heads = few.groupBy("_bucket").agg(F.max("_k").alias("_head")).orderBy("_bucket").collect()  # a row per bucket
    target = [(r["_head"], heads[i - 1]["_bucket"], r["_bucket"]) for i, r in enumerate(heads)]
    firsts = spark.createDataFrame(target or [(0, 0, -1)], "_head long, _to int, _from int")
    hit = F.col("_k").eqNullSafe(F.col("_head")) & (F.col("_bucket") == F.col("_from"))
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("l"))))
    places = places.otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("l")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("l"))))
    both = few.join(F.broadcast(firsts), hit, "left").select("_k", "_t", F.explode(places).alias("p"))
    dealt = both.select("_k", "_t", F.col("p.b").alias("_bucket"), F.col("p.l").alias("_look")).repartition("_bucket")
    return dealt.sortWithinPartitions("_bucket", "_look", F.col("_k").desc_nulls_last(), "_t")


def fingerprint_all(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its fingerprint, its edited text's, and how alike they and the next document's are.

    Documents follow each other by falling key (nulls last; of equal keys, by text), the first after the
    last. Null text: empty. Repeated rows give repeated results. No documents: no rows.
    """
    words = lexicon(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, shared)
        last: tuple | None = None  # the row before, still without its next one
        for b in batches:
            rows = []
            for k, t, bucket, look in zip(b["_k"], b["_t"], b["_bucket"], b["_look"]):
                if last is not None and last[2] == bucket:
                    rows.append(_compared(model, *last[:2], last[3], t, fp := model.fingerprint(t)))
                    last = None if look else (k, t, bucket, fp)
                else:
                    last = None if look else (k, t, bucket, model.fingerprint(t))
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInPandas(run, schema)


_models: dict = {}


def _model(name: str, shared) -> IMatch:
    """One per worker, for the lexicon in use."""
    if name not in _models:
        _models.clear()
        _models[name] = IMatch(shared.value)
    return _models[name]


def _compared(model: IMatch, key, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    fp = own if new == text else model.fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), sha, own, fp, likeness(own, fp), likeness(own, next_own)


def op2_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))
