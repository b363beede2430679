"""Alignment of two tokenizers: which tokens of one overlap which of the other, and where both end together.

A token is a row of a token-byte incidence matrix A (or B); rows and columns are kept as hand-built compressed sparse
rows. The product A Bᵀ, row by row as Gustavson does, has an entry for each pair of tokens that overlap, and it counts
the bytes they share. Places where tokens of both end cut the bytes into groups; the product of the two token-group
incidence matrices has the pairs that share a group.

Neither vocabulary merges across a single space between characters that aren't white space, so both have a token's end
there, and texts are aligned by distinct chunks between such spaces, once each. Over all documents, a block of texts
sends each distinct pair of ids once, with its number of links; the sums come back to the block by its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch, free, small_batches
from sparkforest.llm.tokens import ChunkEncoder, library_encoder, unsafe

#: Characters of texts that make a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Chunks and characters of their groups that a worker's table keeps between blocks, and chunks that are aligned at once.
KEEP, KEEP_CHARS, AT_ONCE = 300_000, 30_000_000, 30_000

Csr = tuple[np.ndarray, np.ndarray]
_loaded: dict = {}


# ---- incidence matrices


def incidence(sizes: np.ndarray) -> Csr:
    """Tokens by bytes: row k has the ``sizes[k]`` bytes after those of the rows before."""
    ptr = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return ptr, np.arange(ptr[-1])


def membership(group: np.ndarray) -> Csr:
    """Tokens by groups: row k has the one entry ``group[k]``."""
    return np.arange(len(group) + 1), group


def transposed(m: Csr, columns: int) -> Csr:
    ptr, cols = m
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    if len(cols) > 1 and (cols[1:] < cols[:-1]).any():
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
    return np.append(0, np.cumsum(np.bincount(cols, minlength=columns))), rows


def product(a: Csr, b: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the entries of a times b, matrices of ones: each row of a gathers the rows of b that it
    names, and equal columns of a row add up."""
    size = np.diff(b[0])[a[1]]
    upto = np.cumsum(size)
    row = np.repeat(np.repeat(np.arange(len(a[0]) - 1), np.diff(a[0])), size)
    col = b[1][np.repeat(b[0][a[1]] - (upto - size), size) + np.arange(len(row))]
    key = row * columns + col
    if len(key) > 1 and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        row, col, key = row[order], col[order], key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return row[first], col[first], np.diff(np.append(first, len(key)))


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ends of groups, group of each token of a, of each of b, overlaps) of tokens with the byte lengths a and b over
    the same bytes; overlaps are (token of a, token of b, bytes that they share), by a, then b."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    both = np.zeros(int(a.sum()) + 1, bool)
    both[ends_b] = True
    ends = ends_a[both[ends_a]]
    links = product(incidence(a), transposed(incidence(b), int(a.sum())), len(b))
    return ends, np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b), links


def shared_groups(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) that lie in one group."""
    return product(membership(group_a), transposed(membership(group_b), groups), len(group_b))[:2]


# ---- the two vocabularies


class TokenBytes:
    """Bytes of each id: ``sizes`` and, one after the other, ``flat`` from ``starts`` on."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = [str(i) for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - (upto - size), size) + np.arange(int(size.sum()))]


def byte_level_tokens(path: str) -> TokenBytes:
    """Byte-level vocabularies write bytes that print as Latin-1 has them, and the others from U+0100 on, in order."""
    from tokenizers import Tokenizer

    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)).difference(prints)))}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        tokens[i] = bytes(map(of.get, t)) if all(c in of for c in t) else t.encode()
    return TokenBytes(tokens)


def piece_encoder(path: str) -> tuple[ChunkEncoder, TokenBytes]:
    """Encoder of texts that begin with a space, which the model puts there itself, and the bytes of its pieces.

    Pieces have U+2581, which stands for a space, at their beginning alone; so single spaces cut words apart.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path}: a piece goes across a space, so texts can't be cut at spaces")
    space = np.array([model.piece_to_id("▁")], "<u4").tobytes()

    def many(texts: list[str]) -> Iterable[bytes]:
        for t, ids in zip(texts, model.encode([t[1:] for t in texts], num_threads=1)):
            yield np.array(ids, "<u4").tobytes() if t != " " else space

    return ChunkEncoder(many, True), TokenBytes([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


# ---- chunks


class ChunkAligner:
    """A worker's table of aligned chunks. A chunk c stands for a space and c; ``bad`` ones have tokens whose bytes
    aren't those. ``links`` are pairs of ids, A's in the upper 32 bits, one for each link, chunk after chunk."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = library_encoder(a_path, True), byte_level_tokens(a_path)
        self.b, self.b_bytes = piece_encoder(b_path)
        self.forget()

    def forget(self) -> None:
        self.chunks, self.groups, self.chars = pa.array([], pa.large_string()), [], 0
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.empty(0, np.int64) for _ in range(4))
        self.bad, self.links, self.starts = np.empty(0, bool), np.empty(0, np.int64), np.zeros(1, np.int64)

    def tokens(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """((ids of A, how many of each text), the same of B, whether both give the bytes of a space and the text)."""
        spaced = [f" {t}" for t in texts]
        found, good = [], np.ones(len(texts), bool)
        want = np.frombuffer("".join(spaced).encode(), np.uint8)
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in spaced), np.int64, len(texts))
        for encoder, table in ((self.a, self.a_bytes), (self.b, self.b_bytes)):
            parts = [(ids, np.diff(ends, prepend=0)) for ids, ends in encoder.slices(spaced)]
            ids, n = (np.concatenate(c) for c in zip(*parts))
            upto = np.append(0, np.cumsum(table.sizes[ids]))[np.append(0, np.cumsum(n))]
            same = np.diff(upto) == size
            got, expected = table.joined(ids[np.repeat(same, n)]), want[np.repeat(same, size)]
            if same.any():
                begin = np.cumsum(size[same]) - size[same]
                same[same] = np.logical_and.reduceat(got == expected, begin)
            good &= same
            found.append((ids, n))
        return found[0], found[1], good

    def learn(self, new: list[str]) -> None:
        (a, per_a), (b, per_b), good = self.tokens(new)
        a, b = a[np.repeat(good, per_a)], b[np.repeat(good, per_b)]
        per_a, per_b = per_a * good, per_b * good
        ends, group_a, group_b, (i, j, _) = align(self.a_bytes.sizes[a], self.b_bytes.sizes[b])
        of_a, of_b = np.repeat(np.arange(len(new)), per_a), np.repeat(np.arange(len(new)), per_b)
        per_group, per_link = (np.bincount(x, minlength=len(new)) for x in (of_a[np.searchsorted(group_a, np.arange(len(ends)))], of_a[i]))
        self.groups.extend(self._written(a, b, group_a, group_b, per_group))
        self.chars += sum(map(len, self.groups[-len(new) :])) + sum(map(len, new))
        join = lambda x, y: np.concatenate([x, y])
        self.chunks = pa.concat_arrays([self.chunks, pa.array(new, pa.large_string())])
        self.n_a, self.n_b, self.n_groups, self.n_links = join(self.n_a, per_a), join(self.n_b, per_b), join(self.n_groups, per_group), join(self.n_links, per_link)
        self.bad, self.links = join(self.bad, ~good), join(self.links, (a[i].astype(np.int64) << 32) | b[j])
        self.starts = join(self.starts, self.starts[-1] + np.cumsum(per_link))

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, per_chunk: np.ndarray) -> list[str]:
        """Each chunk's groups as text: ids of A by commas, a bar, ids of B, groups by semicolons."""
        name_a, name_b = self.a_bytes.names, self.b_bytes.names
        text_a, text_b = [name_a[x] for x in a.tolist()], [name_b[x] for x in b.tolist()]
        every = np.arange(int(per_chunk.sum()) + 1)
        at_a, at_b = np.searchsorted(group_a, every).tolist(), np.searchsorted(group_b, every).tolist()
        groups = [f"{text_a[i] if j - i == 1 else ','.join(text_a[i:j])}|{text_b[k] if m - k == 1 else ','.join(text_b[k:m])}" for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
        ends = np.cumsum(per_chunk).tolist()
        return [";".join(groups[s:e]) for s, e in zip([0, *ends], ends)]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table, where each text ends): the chunks of each text. White space at a text's beginning
        follows the space before it, so such a text is one chunk, and so is one that can't be cut.

        A full table is emptied first, so rows hold until the next call. Here and not between the blocks of a task: a
        worker has many tasks one after the other, each perhaps of one block, and keeps its table.
        """
        if len(self.chunks) > KEEP or self.chars > KEEP_CHARS:
            self.forget()
        whole = [i for i, t in enumerate(texts) if unsafe(t) or t[:1].isspace()]
        values = texts if not whole else [*texts]
        for i in whole:
            values[i] = ""
        lists = pc.split_pattern(pa.array(values, pa.large_string()), " ")
        begin, coded = np.asarray(lists.offsets), lists.values.dictionary_encode()
        names, place = coded.dictionary, np.asarray(coded.indices)
        if whole:
            own = pa.array([texts[i] for i in whole], pa.large_string()).dictionary_encode()
            place = place.copy()
            place[begin[:-1][whole]] = np.asarray(own.indices) + len(names)
            names = pa.concat_arrays([names, own.dictionary])
        known = np.array(pc.index_in(names, value_set=self.chunks).fill_null(-1))
        lacks = known < 0
        if lacks.any():
            n = len(self.chunks)
            new = names.filter(pa.array(lacks)).to_pylist()
            distinct = list(dict.fromkeys(new))  # a text in one piece may equal a chunk
            row = {c: n + k for k, c in enumerate(distinct)}
            for at in range(0, len(distinct), AT_ONCE):
                self.learn(distinct[at : at + AT_ONCE])
            known[lacks] = [row[c] for c in new]
        return known[place], begin[1:]


def aligner(a_path: str, b_path: str) -> ChunkAligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = ChunkAligner(a_path, b_path)
    return _loaded[a_path, b_path]


# ---- documents


def token_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a, a_id, b, b_id, group_no, start, shared): a row for each pair of tokens in one group of a text.

    ``a`` and ``b`` number the tokens from 0, ``start`` is the byte of a space and the text where the group begins, and
    ``shared`` are the bytes that the two overlap in: 0 where they only share the group. Texts that are null or empty,
    or that one vocabulary doesn't give back byte by byte, have no rows. Repeated rows give repeated links.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = aligner(a_path, b_path)
        for b in batches:
            for k, t in zip(b["_k"], b["_t"]):
                (a_ids, _), (b_ids, _), good = model.tokens([t])
                if not t or not good[0]:
                    continue
                ends, group_a, group_b, (i, j, shared) = align(model.a_bytes.sizes[a_ids], model.b_bytes.sizes[b_ids])
                left, right = shared_groups(group_a, group_b, len(ends))
                bytes_of = np.zeros(len(left), np.int64)
                bytes_of[np.searchsorted(left * len(b_ids) + right, i * len(b_ids) + j)] = shared
                begin = np.append(0, ends[:-1])[group_a[left]]
                out = {key: pd.Series([k] * len(left), dtype=b["_k"].dtype), "a": left, "a_id": a_ids[left].astype(np.int64), "b": right, "b_id": b_ids[right].astype(np.int64), "group_no": group_a[left], "start": begin, "shared": bytes_of}
                yield pd.DataFrame(out)

    few = small_batches(docs).select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    return few.mapInPandas(run, f"`{key}` {kind}, a long, a_id long, b long, b_id long, group_no long, start long, shared long")


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _blocks(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """Rows of blocks: one for each document, with the block's numbers of its chunks (``codes``), and one for the block
    (``is_block``), with its distinct pairs of ids, their links (``ns``), and the pairs of each chunk (``links`` up to
    ``ends``)."""
    kind = docs.schema[key].dataType.simpleString()

    def block(model: ChunkAligner, name: int, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        rows, ends = model.codes(texts)
        begin, n = np.append(0, ends[:-1]), len(texts)
        bad = np.logical_or.reduceat(model.bad[rows], begin) | np.fromiter((not t for t in texts), bool, n)
        per_row = np.where(np.repeat(bad, ends - begin), 0, 1)
        sums = [np.where(bad, 0, np.add.reduceat(x[rows], begin)) for x in (model.n_a, model.n_b, model.n_groups, model.n_links)]
        used, codes = np.unique(rows[per_row == 1], return_inverse=True)
        stops = np.cumsum(np.where(bad, 0, ends - begin))
        codes, groups = codes.astype("<i4"), model.groups
        shas, raw = [], []
        for s, e, stop, hides in zip(begin.tolist(), ends.tolist(), stops.tolist(), bad.tolist()):
            shas.append("" if hides else hashlib.sha256(";".join([groups[r] for r in rows[s:e].tolist()]).encode()).hexdigest())
            raw.append(b"" if hides else codes[stop - (e - s) : stop].tobytes())
        size = model.n_links[used]
        upto = np.cumsum(size)
        each = model.links[np.repeat(model.starts[:-1][used] - (upto - size), size) + np.arange(int(size.sum()))]
        links, pairs = pd.factorize(each)
        ns = np.bincount(links, weights=np.repeat(np.bincount(codes, minlength=len(used)), size), minlength=len(pairs)).astype(np.int64)
        lists = lambda x: pa.array([None] * n + [x], pa.list_(pa.int64()))
        plain = [pa.array([*x.tolist(), 0], pa.int64()) for x in sums]
        columns = [
            pa.array(np.full(n + 1, name), pa.int64()), pa.array([False] * n + [True]), pa.concat_arrays([keys, pa.nulls(1, keys.type)]), *plain, pa.array([*shas, ""]),
            pa.array([*raw, b""], pa.binary()), lists(pairs), lists(ns), pa.array([b""] * n + [links.astype("<i4").tobytes()], pa.binary()), pa.array([b""] * n + [upto.astype("<i8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "is_block", "_k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "pairs", "ns", "links", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, name = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        keys, texts, chars = [], [], 0
        for b in batches:
            at = 0
            for k, t in enumerate(b.column(1).to_pylist()):
                if texts and chars + len(t) > BLOCK:
                    yield block(model, name, pa.concat_arrays([*keys, b.column(0).slice(at, k - at)]), texts)
                    keys, texts, chars, at, name = [], [], 0, k, name + 1
                texts.append(t)
                chars += len(t)
            keys.append(b.column(0).slice(at))
        if texts:
            yield block(model, name, pa.concat_arrays(keys), texts)

    few = small_batches(docs).select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    return few.mapInArrow(run, f"block long, is_block boolean, _k {kind}, {_FIELDS}, codes binary, pairs array<long>, ns array<long>, links binary, ends binary")


def pair_totals(blocks: DataFrame) -> DataFrame:
    """(pair, links, is_best): how many links of all documents hold each pair of ids, and whether no other pair of the
    same id of B has more. An id of B has at most as many pairs as A has ids, which bounds a window."""
    counted = blocks.where("is_block").select(F.explode(F.arrays_zip("pairs", "ns")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.ns").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counted.select("pair", "links", (F.col("links") == most).alias("is_best"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    Links are pairs of overlapping tokens; a pair of ids counts in as many links as it has over all rows. ``n_best``:
    links whose count is the highest of their id of B (ties too); ``count_sum``: the counts of all links. Null and empty
    texts, and those that one vocabulary doesn't give back byte by byte, have zeros and an empty digest. Repeated rows
    count each time and stay; null keys stay. Blocks are bounded by BLOCK characters or one text.
    """
    kind, scratch = docs.schema[key].dataType.simpleString(), Scratch(docs.sparkSession)
    blocks = scratch.store(_blocks(docs, a_path, b_path, key, text))
    totals = scratch.store(pair_totals(blocks))
    asked = blocks.where("is_block").select(F.col("block").alias("asker"), F.explode("pairs").alias("pair"))
    known = asked.join(totals, "pair").select("asker", "pair", "links", "is_best")
    name = free("_k", [key])

    def finish(rows: pa.Table, sums: pa.Table) -> pa.Table:
        own = rows.filter(rows["is_block"]).to_pydict()
        docs_of = rows.filter(pc.invert(rows["is_block"]))
        pairs = np.array(own["pairs"][0], np.int64)
        pair = np.asarray(sums["pair"])
        order = np.argsort(pair)
        at = order[np.searchsorted(pair[order], pairs)] if len(pairs) else np.empty(0, np.int64)
        count, best = np.asarray(sums["links"])[at], np.asarray(sums["is_best"])[at].astype(np.int64)
        links, ends = np.frombuffer(own["links"][0], "<i4"), np.frombuffer(own["ends"][0], "<i8")
        of = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x[links]))[ends]))
        sums_of, best_of = of(count), of(best)
        total = {"n_best": [], "count_sum": []}
        for raw in docs_of["codes"].to_pylist():
            codes = np.frombuffer(raw, "<i4")
            total["n_best"].append(int(best_of[codes].sum()))
            total["count_sum"].append(int(sums_of[codes].sum()))
        columns = [docs_of["_k"], *[docs_of[c] for c in ("n_a", "n_b", "n_groups", "n_links")], *[pa.array(total[c], pa.int64()) for c in total], docs_of["groups_sha256"]]
        return pa.table(columns, names=[name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    both = blocks.groupBy("block").cogroup(known.groupBy("asker"))
    out = both.applyInArrow(finish, f"`{name}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed(name, key)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public vocabularies over all ``documents``; see ``align_corpus`` for nulls, ties and repeats."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
