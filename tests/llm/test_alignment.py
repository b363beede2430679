"""Token alignment against the definition, with the libraries' own tokens of whole texts."""

import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, none, odd  # noqa: F401

from sparkforest.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in prints}
    rest = [x for x in range(256) if x not in prints]
    byte_of.update({chr(256 + k): x for k, x in enumerate(rest)})
    of_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, of_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, of_b(i)) for i in b.encode(t)]


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(text, libraries):
    """(tokens of A, tokens of B, groups, links) of one text; links are (place in A, place in B, bytes shared)."""
    if not text:
        return None
    a, b = (f(text) for f in libraries)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    a, b = spans(a), spans(b)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = [([], []) for _ in ends]
    for side, tokens in enumerate((a, b)):
        for i, _, e in tokens:
            groups[bisect.bisect_left(ends, e)][side].append(i)
    links, k = [], 0
    for x, (_, s, e) in enumerate(a):
        while k < len(b) and b[k][2] <= s:
            k += 1
        y = k
        while y < len(b) and b[y][1] < e:
            links.append((x, y, min(e, b[y][2]) - max(s, b[y][1])))
            y += 1
    return a, b, groups, links


def brute_rows(docs, libraries):
    found = [(key, brute(text, libraries)) for key, text in docs]
    count = collections.Counter((f[0][x][0], f[1][y][0]) for _, f in found if f for x, y, _ in f[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for key, f in found:
        if not f:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        pairs = [(a[x][0], b[y][0]) for x, y, _ in links]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = (rng.random((rng.integers(1, 9), 7)) < 0.4 for _ in range(2))
        csr = lambda m: (np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1])
        row, col, n = alignment.product(csr(a), alignment.transposed(csr(b), 7), len(b))
        dense = np.zeros((len(a), len(b)), int)
        dense[row, col] = n
        assert (dense == a.astype(int) @ b.T.astype(int)).all()


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="abtheIN 's\n\t.!9é²\x1cΣ🙂▁　­<|>0x/_", max_size=60), min_size=1, max_size=6))
def test_chunks_give_the_groups_of_whole_texts(libraries, texts):
    model = alignment.aligner(A, B)
    rows, ends = model.codes(texts)
    for t, s, e in zip(texts, [0, *ends.tolist()], ends.tolist()):
        want = brute(t, libraries)
        if not t:
            continue
        assert bool(model.bad[rows[s:e]].any()) == (want is None)
        if want:
            assert ";".join(model.groups[r] for r in rows[s:e]) == ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in want[2])
            assert model.n_links[rows[s:e]].sum() == len(want[3])


def test_links_of_tokens(spark, libraries):
    texts = {1: "Überraschung <|endoftext|> naïve  x", 2: "", 3: None, 4: "a▁b", 5: "don't\n stop 12345"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in alignment.token_links(docs, A, B).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == {1, 5}
    for key, rows in got.items():
        a, b, groups, links = brute(texts[key], libraries)
        assert sorted((r["a"], r["b"], r["shared"]) for r in rows if r["shared"]) == sorted(links)
        assert len(rows) == sum(len(g) * len(h) for g, h in groups)
        assert all((r["a_id"], r["b_id"]) == (a[r["a"]][0], b[r["b"]][0]) for r in rows)


def test_rows_of_any_kind(spark, libraries, odd, none):  # noqa: F811
    docs = odd.withColumn("n_a", F.lit(7)).withColumn("block", F.lit("x"))
    got = sorted(map(tuple, alignment.align_corpus(docs, A, B).collect()), key=str)
    assert got == brute_rows([(r["doc_id"], r["text"]) for r in odd.collect()], libraries)
    assert alignment.align_corpus(none, A, B).collect() == []


def test_blocks_of_one_text_each_give_the_same(spark, odd, monkeypatch):  # noqa: F811
    whole = sorted(map(str, alignment.align_corpus(odd, A, B).collect()))
    monkeypatch.setattr(alignment, "BLOCK", 1)
    monkeypatch.setattr(alignment, "KEEP", 1)
    assert sorted(map(str, alignment.align_corpus(odd.coalesce(1), A, B).collect())) == whole


def test_query(spark, libraries):
    out = queries.queries()["op11_token_alignment"](spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, out.collect()), key=str) == brute_rows([tuple(d) for d in docs], libraries)


def test_a_workers_table_is_bounded_over_tasks_of_one_block(monkeypatch):
    monkeypatch.setattr(alignment, "KEEP", 50)
    table = alignment.ChunkAligner(A, B)
    for task in range(8):
        rows, ends = table.codes([" ".join(f"w{task}x{k}" for k in range(40)), "the same"])
        assert table.chunks.take(rows[ends[0] :]).to_pylist() == ["the", "same"]
        assert len(table.chunks) <= 50 + 42
    assert len(table.groups) == len(table.n_a) == len(table.starts) - 1 == len(table.chunks)
