"""Registered queries and pipeline stages against plain versions, on a small table."""

import collections
import hashlib
import math
import re
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, base, brute_components, brute_lines

import corpus_pipeline
from sparkforest.llm import fingerprints, language, quality_model, quality_rules, queries, token_files
from sparkforest.llm._util import Scratch, scratch_path

BREAK = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()))


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


def library_ids(name, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def check_packing(rows, docs):
    """Pieces are the library's ids, each in one place of a gapless sequence."""
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for (key, *_), ids in zip(docs, library_ids("word_bpe_49k.json", [d[1] for d in docs])):
        for at in range(0, len(ids), 2048):
            want[key, at // 2048] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert got == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_query(spark, documents):
    check_packing(queries.queries()["op1_best_fit_packing"](spark, SF).collect(), documents)


def test_token_file_query(spark, documents):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.queries()["op8_token_files"](spark, SF).collect()}
    want, start = {}, 0
    for (key, *_), ids in zip(documents, library_ids("byte_bpe_50k.json", [d[1] for d in documents])):
        want[key] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_token_files_have_bloom_filters_and_indexes(spark):
    path = scratch_path(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_token_files(token_files.token_arrays(docs, P.path("byte_bpe_50k.json")).coalesce(1), path, row_index_stride=1000)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    kinds = set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in rows.readStripeFooter(stripe).getStreamsList()}
    assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= kinds  # column 1 is the key
    read = token_files.read_token_files(spark, path)
    one = read.where("doc_id = 7").select("doc_id")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString() and one.count() == 1


def grams(text):
    """1-, 2- and 3-grams within words of letters, as tuples of code points."""
    out = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split(" "):
        if word:
            w = [32, *map(ord, word), 32]
            out.update((c,) for c in w[1:-1])
            out.update(zip(w, w[1:]))
            out.update(zip(w, w[1:], w[2:]))
    return out


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[: language.PROFILE]


def languages(learn, texts):
    """(language, score) of each text by out-of-place distance."""
    sums = collections.defaultdict(collections.Counter)
    for text, lang in learn:
        if text is not None and lang is not None:
            sums[lang].update(grams(text))
    places = {name: {g: i for i, g in enumerate(ranked(c))} for name, c in sums.items()}
    out = []
    for text in texts:
        own = ranked(grams(text or ""))
        if not own:
            out.append((language.UNKNOWN, 0.0))
            continue
        far = {n: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(own)) / (language.PROFILE * len(own)) for n, p in places.items()}
        best = min(sorted(far), key=far.get)
        out.append((best, 1 / sum(math.exp(language.SHARPNESS * (far[best] - d)) for d in far.values())))
    return out


def test_language_query(spark, documents):
    want = languages([d[1:] for d in documents if remainder(d[0], 3) != 1], [d[1] for d in documents])
    got = {r["doc_id"]: r for r in queries.queries()["op10_language_id"](spark, SF).collect()}
    for (key, *_), (name, score) in zip(documents, want):
        assert got[key]["held_out"] == (remainder(key, 3) == 1) and got[key]["lang_pred"] == name and abs(got[key]["score"] - score) < 1e-9


def classes(text):
    out = [0] * 6
    for c in text:
        out[0 if unicodedata.category(c) == "Lu" else 1 if c in "0123456789" else 2 if re.match(BREAK, c) else 3 if c in "#*$%&|<>" else 4 if c in "!\"'()+,-./:;=?@[\\]^_`{}~" else 5] += 1
    return out


def divergence(p, q):
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    return math.sqrt(max(0.0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2))


def verdicts(docs):
    """(char distance, word distance, kept) of each (key, text, lang)."""
    chars, words = collections.defaultdict(lambda: [0] * 6), collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        if text is not None and lang is not None:
            chars[lang] = [a + b for a, b in zip(chars[lang], classes(text))]
            words[lang].update(w for w in re.split(BREAK, text) if w)
    chars = {k: [x / sum(v) for x in v] for k, v in chars.items() if words[k]}
    common = {k: sorted(c, key=lambda w: (-c[w], w.encode()))[: quality_rules.COMMON] for k, c in words.items() if c}
    every = sorted({w for ws in common.values() for w in ws})
    shares = {}
    for k, ws in common.items():
        own = [words[k][w] / sum(words[k].values()) if w in ws else 0.0 for w in every]
        shares[k] = [*own, 1 - sum(own)]
    out = []
    for _, text, _ in docs:
        n_words, *_, repeated = base(text)
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        char = word = None
        if len(text or "") >= quality_rules.GUARD_CHARS:
            char = min(divergence([x / len(text) for x in classes(text)], q) for q in chars.values())
        if n_words >= quality_rules.GUARD_WORDS:
            c = collections.Counter(re.split(BREAK, text))
            own = [c[w] / n_words for w in every]
            word = min(divergence([*own, 1 - sum(own)], q) for q in shares.values())
        most = quality_rules.MOST_MANY if n_words >= quality_rules.GUARD_MANY else quality_rules.MOST_WORDS
        out.append((char, word, not failed and (char or 0) <= quality_rules.MOST_CHARS and (word or 0) <= most))
    return out


def test_quality_rule_query(spark, documents):
    got = {r["doc_id"]: r for r in queries.queries()["op6_quality_rules"](spark, SF).collect()}
    for (key, *_), (char, word, kept) in zip(documents, verdicts(documents)):
        r = got[key]
        for value, want in ((r["char_distance"], char), (r["word_distance"], word)):
            assert (value is None) == (want is None) and (want is None or abs(value - want) < 1e-6)
        assert r["kept"] == kept


def test_fingerprint_query(spark, documents):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", low))

    def digest(parts):
        return f"{int.from_bytes(hashlib.blake2b(bytes(1).join(parts), digest_size=2).digest(), 'big') or 1:04x}"

    texts = [d[1] or "" for d in reversed(documents)]
    n, df, copies = len(texts), collections.Counter(), collections.defaultdict(list)
    for text in texts:
        df.update(terms(text))
    often = sorted((t for t in df if df[t] > 0.2 * n), key=lambda t: (-df[t], t.encode()))
    for text in texts:
        if found := terms(text):
            copies[tuple(sorted(zlib.crc32(t.encode()) for t in found)[:3])].append([t in found for t in often])
    in_classes = np.array([max(rows) for rows in copies.values()]).sum(axis=0)
    band = {t for t in df if max(2, 0.001 * n) <= df[t] <= max(2, 0.2 * n)} | {t for t, k in zip(often, in_classes) if k <= 0.2 * len(copies)}

    def fingerprint(text):
        draw = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
        inside, outside = sorted(terms(text) & band, key=str.encode), terms(text) - band
        taken = [draw(t) for t in inside]
        taken += sorted(map(draw, outside), key=lambda d: d[:8])[: max(0, 24 - len(taken))]
        out = [digest([draw(t)[:8] for t in inside] or [b"-", *sorted(t.encode() for t in outside)])]
        for level in range(5):
            of = lambda d: (int.from_bytes(d[8:], "little") >> 11 * level) % (24 * 4**level)  # noqa: B023, E731
            for cell in range(24):
                codes = sorted(d[:8] for d in taken if of(d) == cell)
                out.append(digest(codes) if codes else "0000")
        return out

    def likeness(a, b):
        if a == b:
            return 1.0
        levels = [(a[1 + 24 * k : 25 + 24 * k], b[1 + 24 * k : 25 + 24 * k]) for k in range(5)]
        either = [sum(x != "0000" or y != "0000" for x, y in zip(*v)) for v in levels]
        same = [sum(x == y != "0000" for x, y in zip(*v)) for v in levels]
        first = max((k for k in range(5) if either[k] >= 12), default=0)
        return sum(same[first:]) / max(1, sum(either[first:]))

    got = {r["doc_id"]: r for r in queries.queries()["op2_imatch"](spark, SF).collect()}
    own = [fingerprint(t) for t in texts]
    for i, (key, *_) in enumerate(reversed(documents)):
        text, after = texts[i], texts[(i + 1) % n]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        new, r = fingerprint(edited), got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(own[i]), "".join(new))
        assert abs(r["near_edited"] - likeness(own[i], new)) < 1e-12 and abs(r["near_next"] - likeness(own[i], own[(i + 1) % n])) < 1e-12


def test_quality_ranking_query(spark, documents):
    """The pairs drawn anew, their loss minimised by Newton steps: the query's weights reach it, and its scores agree."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if remainder(r["doc_id"], 4) != 2}
    texts = {d[0]: d[1] or "" for d in documents if d[0] in labels}
    chain = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))
    place = lambda k: (xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % (1 << 32), k)
    good, bad = (sorted((k for k in texts if labels[k] == y), key=place) for y in (1, 0))
    x = {k: np.array(quality_model.features(t)) for k, t in texts.items()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    d = np.array([x[good[signed(chain(b + 1, p)) % len(good)]] - x[k] for b, k in enumerate(bad) for p in range(4)])
    # Every second loser's differences are turned round with the outcome, which leaves the loss as it is but not the spread.
    turned = d * np.repeat([1 if (b + 1) % 2 else -1 for b in range(len(bad))], 4)[:, None]
    penalty = 1e-4 * turned.var(axis=0, ddof=1)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + (penalty * w * w).sum() / 2
    w = np.zeros(d.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(penalty + 1e-12), (p[:, None] * d).mean(axis=0) - penalty * w)
        rate = 1.0
        while rate > 1e-6 and loss(w + rate * step) > loss(w):
            rate /= 2
        w = w + rate * step
    seen = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("doc_id", F.col("quality").alias("label"))
    weights, threshold = quality_model.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels=seen)
    assert loss(np.array(weights)) <= loss(w) + 0.01
    got = {r["doc_id"]: r for r in queries.queries()["op3_quality_ranking"](spark, SF).collect()}
    agree = 0
    for key, text, _ in documents:
        raw = float(np.array(quality_model.features(text or "")) @ weights) + math.log(0.7 / 0.3) - threshold
        score = 1 / (1 + math.exp(-max(-500, min(500, raw))))
        assert abs(got[key]["score"] - score) < 1e-9 and got[key]["held_out"] == (remainder(key, 4) == 2)
        agree += got[key]["predicted"] == (score >= 0.7)
    assert agree == len(documents)


def test_pipeline_stages(spark):
    """Each stage's rows from what the one before has kept, in columns of documents."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = scratch.store(stages[name](spark, docs, SF))
        assert out.columns == columns
        return out, rows(out)

    def rows(df):
        return sorted(((r["doc_id"], r["text"], r["lang"]) for r in df.collect()), key=lambda r: (r[0], r[1] or ""))

    before = rows(docs)
    named = languages([d[1:] for d in before], [d[1] for d in before])
    docs, got = run("language", docs)
    assert got == [(d[0], d[1], n) for d, (n, score) in zip(before, named) if n != language.UNKNOWN and score >= corpus_pipeline.LANGUAGE_SCORE]
    docs, kept = run("quality_rules", docs)
    assert kept == [d for d, (_, _, good) in zip(got, verdicts(got)) if good] and kept
    docs, got = run("line_dedup", docs)
    gone = brute_lines([d[:2] for d in kept])
    want = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone), n) for k, t, n in kept]
    assert got == [d for d in want if re.sub(BREAK, "", d[1])] and gone
    docs, kept = run("near_duplicates", docs)
    roots = brute_components({d[0]: d[1] for d in got}, 5)
    assert kept == [d for d in got if roots[d[0]][1] == d[0]]
    check_packing(stages["packing"](spark, docs, SF).collect(), kept)
