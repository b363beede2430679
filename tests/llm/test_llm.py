import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sparkforest.llm import bpe, fingerprints, language, licenses, line_dedup, near_duplicates, packing, quality_model, quality_rules, queries, token_files, tokens
from sparkforest.llm._util import Scratch, scratch_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, ids string, bin int"
WORDS = "the of and a in to was is that for on with as by at it from be are this".split()


def doc(i, text, lang="en"):
    return (i, text, lang, "src0", 0 if text is None else len(text), None, None, None, None)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(WORDS[i % 20] + str(i % 977) for i in range(30_000))
    same = " ".join(WORDS * 3)
    rows = [doc(0, None, None), doc(1, ""), doc(2, " \n\t "), doc(3, same), doc(4, same), doc(4, same), doc(5, long), doc(6, "naïve ²½ Ⅷ 🙂 don't  I'LL\n\n x" * 3), (None,) * 9, doc(7, "one two"), doc(8, "one two")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def reference_bpe(ranks, word):
    """Plain byte-pair merging: the lowest rank first, the leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([c]) for c in word]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[x] for x in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abtheIN 's\n\t.!9é²\x1cΣ🙂", max_size=80), max_size=6))
def test_chunked_encoding_is_exact(texts):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc, _ = bpe.rank_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [known.encode_ordinary(t) for t in texts]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tok = Tokenizer.from_file(P.path(name))
        tok.encode_special_tokens = True
        got = [np.frombuffer(x, "<u4").tolist() for x in tokens.library_encoder(P.path(name), spaced).encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_matrix_and_heap_merging():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    m, rng = bpe.MatrixBpe(ranks), np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abeinorst"), n).tolist()) for n in [*range(0, 66), 90, 128, 129, 255, 256, 257, 300]]
    assert [x.tolist() for x in m.encode(words)] == [reference_bpe(ranks, w) if w else [] for w in words]


def test_bpe_round_trip(spark, odd, none):
    out = bpe.digests(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect())
    assert sorted(r["decoded_sha256"] for r in out) == want
    assert bpe.digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    both = bpe.decode_ids(bpe.encode_texts(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())


def test_packing(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    out = packing.pack(odd, path, 256).toPandas()
    pieces = packing.token_pieces(odd, path, 256).toPandas()
    assert out["length"].sum() == pieces["length"].sum() and len(out) == len(pieces)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 256 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("lengths", [[5] * 300, [1] * 50, [60, 41, 40, 39, 20, 1], list(range(1, 101)) * 3, [34] * 90, [50, 50, 51, 49]])
def test_best_fit_is_close_to_the_bound(spark, lengths):
    items = Scratch(spark).store(spark.createDataFrame(list(enumerate(lengths)), "uid long, length long"))
    out = packing.best_fit(items, 100).toPandas()
    assert sorted(out["uid"]) == list(range(len(lengths)))
    assert out.groupby("sequence_id")["length"].sum().max() <= 100
    bins: list[int] = []  # best fit by falling length, one after the other
    for n in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b + n <= 100]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    assert out["sequence_id"].nunique() <= 1.03 * len(bins) + 1


def test_token_files(spark, odd, none):
    path = scratch_path(spark)
    token_files.write_token_files(token_files.token_arrays(odd, P.path("byte_bpe_50k.json")), path)
    got = token_files.token_index(token_files.read_token_files(spark, path)).toPandas().sort_values("start")
    assert len(got) == odd.count() and (got["start"] == got["n_tokens"].cumsum() - got["n_tokens"]).all()
    assert got["doc_id"].isna().iloc[0] and got["doc_id"].iloc[1:].is_monotonic_increasing
    ids = [int(x) for x in np.frombuffer(next(iter(tokens.library_encoder(P.path("byte_bpe_50k.json"), True).encode(["one two"]))), "<u4")] + [0]
    assert got[got["doc_id"] == 7]["ids_crc32"].item() == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert token_files.token_index(token_files.read_token_files(spark, path).where("doc_id < 0")).count() == 0


def test_fingerprints(spark, odd, none):
    out = fingerprints.fingerprint_all(odd).toPandas()
    texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas().sort_values(["doc_id", "text"], ascending=[False, True], na_position="last")["text"].tolist()
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1]))
    assert sorted(out["edited_sha256"]) == want
    assert out[out["doc_id"].isin([3, 4])]["fingerprint"].nunique() == 1
    assert out[["near_edited", "near_next"]].to_numpy().min() >= 0 and out[["near_edited", "near_next"]].to_numpy().max() <= 1
    assert fingerprints.fingerprint_all(none).count() == 0


def test_fingerprints_tell_edited_texts(spark):
    out = queries.queries()["op2_imatch"](spark, SF).toPandas()
    assert (out["near_edited"] > out["near_next"]).mean() > 0.8


def test_fingerprints_of_a_large_group_of_near_copies(spark):
    """More than MOST of all rows share their terms, and still tell edited texts; so do texts of common terms only."""
    rng, rows = np.random.default_rng(21), []
    common = [f"c{i}" for i in range(40)]
    words = [f"g{i}" for i in range(200)]
    for i in range(300):
        if i % 3 == 1:
            own = list(words)
            for p in rng.choice(200, 6, replace=False):
                own[p] = f"n{rng.integers(0, 10**6)}"
        else:
            own = [f"w{k}" for k in rng.integers(0, 3000, 150)]
        rows.append((i, " ".join(own + common)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    band = set(fingerprints.lexicon(df))
    assert sum(w.encode() in band for w in words) > 190 and not any(w.encode() in band for w in common)
    got = fingerprints.fingerprint_all(df).where("doc_id % 3 = 1").toPandas()
    assert got["near_edited"].median() > 0.3 and got["near_next"].median() < 0.2
    model = fingerprints.IMatch(sorted(band))
    a, b, c = (model.fingerprint(" ".join(x)) for x in (common[:20], common[1:21], common[20:]))
    assert fingerprints.likeness(a, b) > 0.6 > 0.2 > fingerprints.likeness(a, c)


def test_lexicon_has_all_terms_of_the_band(spark):
    n = (1 << 18) + 5000
    texts = spark.range(12).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k.cast("string")), " ").alias("text"), "id").where("id < 2")
    texts = texts.select("text").unionAll(spark.range(10).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("text")))
    assert len(set(fingerprints.lexicon(texts))) == n


def test_language(spark, odd, none):
    profiles = {"en": language.top(*language.ngram_counts(" ".join(WORDS))).tolist(), "fr": language.top(*language.ngram_counts("le la des une pour dans que qui")).tolist()}
    out = language.identify(odd, profiles).select("doc_id", "lang_pred", "score").toPandas().set_index("doc_id")
    assert out.loc[[0, 1, 2], "lang_pred"].eq("und").all() and out.loc[3, "lang_pred"] == "en"
    assert language.identify(none, profiles).count() == 0 and language.learn_profiles(none) == {}
    got = queries.queries()["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_quality_model(spark, odd, none):
    out = quality_model.score(odd, [0.0] * len(quality_model.FEATURES), 0.0)
    assert out.where("score between 0 and 1").count() == odd.count() and quality_model.score(none, [0.0] * len(quality_model.FEATURES), 0.0).count() == 0
    assert quality_model.fit(none.withColumn("label", F.lit(1))) == ([0.0] * len(quality_model.FEATURES), 0.0)
    got = queries.queries()["op3_quality_ranking"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ref = quality_rules.References(odd)
    for r in quality_rules.judge(odd, ref).collect():
        assert tuple(r[n] for n in names) == base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert quality_rules.judge(none, quality_rules.References(none)).count() == 0
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    got = spark.range(1).select(quality_rules.distance(F.lit(p), q).alias("d")).first()["d"]
    assert abs(got - 0.5**0.5) < 1e-12


def test_quality_rules_on_documents(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op6_quality_rules"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert tuple(got[r["doc_id"]][n] for n in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]) == base(r["text"])


def brute_components(texts, width, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng, rows = np.random.default_rng(3), {}
    for g in range(12):
        words = [f"w{rng.integers(0, 400)}" for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 6)):
            own = list(words)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = f"x{rng.integers(0, 50)}"
            rows[len(rows)] = " ".join(own).title() if g % 2 else " ".join(own)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.link(df, 4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    out = near_duplicates.link(odd, 4).collect()
    assert len(out) == odd.count()
    got = {r["doc_id"]: r for r in out}
    assert got[4]["component_id"] == 3 and not got[4]["kept"] and got[8]["component_id"] == 7
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (0, 1, 2, None))
    assert near_duplicates.link(none).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 4000, np.uint64)
    a, b = near_duplicates.registers(x[:3000]), near_duplicates.registers(x[1000:])
    assert (np.maximum(a, b) == near_duplicates.registers(x)).all()
    j = near_duplicates.joint_estimate(a[None], b[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 0.5) < 0.12


def brute_lines(docs, least=1):
    lines = sorted((i, k, set(w for w in re.split(r"[\x20\x09-\x0D]+", x) if w)) for i, t in docs for k, x in enumerate((t or "").split("\n")) if t is not None)
    lines = [x for x in lines if len(x[2]) >= least]
    return {(i, k) for n, (i, k, s) in enumerate(lines) if any((a, b) != (i, k) and 10 * len(s & o) >= 8 * len(s | o) for a, b, o in lines[:n])}


def test_line_dedup_matches_brute_force(spark):
    rng, docs = np.random.default_rng(9), []
    pool = [[f"w{rng.integers(0, 60)}" for _ in range(rng.integers(4, 30))] for _ in range(15)]
    for i in range(25):
        text = []
        for _ in range(4):
            w = list(pool[rng.integers(0, 15)])
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = f"y{rng.integers(0, 9)}"
            text.append(" ".join(w))
        docs.append((i, "\n".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = {tuple(r) for r in line_dedup.repeated(df).collect()}
    assert gone == brute_lines(docs)
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert new == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_pipeline_drops_repeated_lines_of_any_length(spark):
    rng, docs = np.random.default_rng(13), []
    for i in range(40):
        docs.append((i, "\n".join(" ".join(f"w{k}" for k in rng.integers(0, 7, rng.integers(0, 8))) for _ in range(4)) + f"\nAll rights reserved.\nonly{i}"))
    df = spark.createDataFrame([doc(*d) for d in docs], DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    gone = brute_lines(docs, 1)
    assert {(i, 4) for i in range(1, 40)} <= gone
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, df, SF).collect()}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_rows_that_repeat_a_key_lose_their_own_lines_only(spark):
    rows = [(1, "one line that is said twice\nx"), (2, "one line that is said twice\na"), (2, "my own line that nobody else has\nb"), (3, "y\ty\nY y"), (4, "y"), (5, None), (5, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_removed"]) for r in got) == sorted([(1, rows[0][1], 0), (2, "a", 1), (2, rows[2][1], 0), (3, rows[3][1], 0), (4, "", 1), (5, "", 0), (5, "", 0)])


def test_variants_of_one_line_match_brute_force(spark):
    """A large group of variants, of which many aren't near the hub."""
    rng, words, docs = np.random.default_rng(15), [f"w{i}" for i in range(40)], []
    for i in range(150):
        own = list(words)
        for p in rng.choice(40, rng.integers(0, 9), replace=False):
            own[p] = f"x{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(own)))
    gone = {tuple(r) for r in line_dedup.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert gone == brute_lines(docs)


def test_line_dedup_of_odd_rows(spark, odd, none):
    out = line_dedup.dedup_lines(odd).collect()
    assert len(out) == odd.count() and {r["doc_id"]: r["text"] for r in out}[4] == "" and {r["doc_id"]: r["text"] for r in out}[0] is None
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    plain = lambda d: sorted(tuple("" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    fix = lambda rows: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows]
    assert sorted(got.columns) == sorted(want.columns) and fix(plain(got)) == fix(plain(want))


def test_license_inheritance(spark, none):
    mit, apache = "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0."
    files = spark.createDataFrame([("a/LICENSE", mit), ("a/b/c/x.py", "code"), ("a/b/LICENSE.txt", apache), ("a/y.py", apache), ("z/q.py", None), (None, mit), ("a/b/c/x.py", "code")], "path string, text string")
    got = {r["path"]: r for r in licenses.inherit(files, licenses.scan(files)).collect()}
    assert got["a/b/c/x.py"]["license"] == "Apache-2.0" and got["a/b/c/x.py"]["levels"] == 2
    assert got["a/y.py"]["license"] == "Apache-2.0" and got["a/y.py"]["levels"] == 0
    assert got["z/q.py"]["license"] is None and len(got) == 5
    empty = none.select(F.col("source").alias("path"), "text")
    assert licenses.inherit(empty, licenses.scan(empty)).count() == 0


def test_license_identifiers_blocks_and_files(spark):
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() {\n  return 0;\n}"
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n# 1. Redistributions of source code must retain the above copyright notice, this\n#    list of conditions and the following disclaimer.\n# 2. Redistributions in binary form must reproduce the above copyright notice,\n#    this list of conditions and the following disclaimer in the documentation\n#    and/or other materials provided with the distribution.\n"
    want = {
        "a.c": ("// SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0"), "b.c": ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0-or-later"), "c.h": ("<!-- SPDX-License-Identifier: (MIT OR BSD-3-Clause)-->", "(MIT OR BSD-3-Clause)"),
        "d.c": (gpl, "GPL-3.0"), "e.c": (gpl.replace("General", "Lesser General").replace("program", "library"), "LGPL-3.0"), "f/LICENSE": (mit, "MIT"), "g.py": (bsd, "BSD-2-Clause"),
        "h.py": (bsd + "# 3. Neither the name of the copyright holder nor the names of its\n#    contributors may be used to endorse or promote products derived from\n#    this software without specific prior written permission.\nimport os", "BSD-3-Clause"),
        "i/COPYING": ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation", "GPL-3.0"), "j/COPYING": ("GNU GENERAL PUBLIC LICENSE", "GPL"), "k": ("general software published under other conditions", None), "l": ("SPDX-License-Identifier: NONE", None),
    }
    got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame([(k, v[0]) for k, v in want.items()], "path string, text string")).collect()}
    assert got == {k: v for k, (_, v) in want.items() if v}


def test_pipeline(spark, none):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, docs, SF)
        assert new.count() == 0 and (i == 4 or new.columns == docs.columns)


def test_repeated_keys_with_other_texts_keep_their_links(spark):
    t1, t2 = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(120))
    rows = [(5, t1), (5, t2), (6, t1 + " x"), (7, t2 + " y")]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5)]


def test_words_that_collide_in_polynomial_hashes_are_not_linked(spark):
    """Thue-Morse words collide for any base modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(7))
    got = near_duplicates.link(spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string"), 4).collect()
    assert all(r["kept"] for r in got)


def test_one_row_of_a_group_stays(spark):
    t1, t2 = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(120))
    rows = [(5, t1, "x"), (5, t2, None), (5, t2, None), (6, t1 + " x", "y"), (7, t2 + " y", "z"), (8, None, "n"), (8, None, "n"), (None, t1, "k"), (9, "", "e")]
    got = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _near_id string"))
    assert got.columns == ["doc_id", "text", "_near_id"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], *rows[5:]], "doc_id long, text string, _near_id string").collect()))


def test_exact_sets_and_estimates():
    texts = ["a b c d e f", "A b  c d", "a b", "b a", "", "x a b c d e"]
    sets = near_duplicates.ExactSets(texts, 3)
    want = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in (t.lower().split() for t in texts)]
    assert [len(s) for s in sets.sets] == [len(w) for w in want]
    assert all(sets.overlaps(i, [j])[0] == len(want[i] & want[j]) for i in range(6) for j in range(6) if want[j])
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 4000, np.uint64)
    regs = np.stack([near_duplicates.registers(x[k * 100 : 2000 + k * 100]) for k in range(15)])
    n, first = np.full(15, 2000.0), np.broadcast_to(regs[0], regs.shape)
    near = near_duplicates.joint_estimate(first, regs, n, n)
    for least in (0.3, 0.6, 0.9):
        apart = np.abs(near - least) > 1e-4
        assert ((near >= least) == near_duplicates.estimate_reaches(first, regs, n, n, least))[apart].all()


def test_large_group_of_near_copies_is_one_component(spark):
    """Copies that are mostly not near enough to the first one, and hold together through others."""
    rng, rows = np.random.default_rng(11), {}
    words = [f"w{i}" for i in range(200)]
    for i in range(150):
        own = list(words)
        for p in rng.choice(200, rng.integers(1, 8), replace=False):
            own[p] = f"x{rng.integers(0, 10**6)}"
        rows[i] = " ".join(own)
    got = near_duplicates.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, 4)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    """With blocks of a few rows."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 8)
    rng, rows = np.random.default_rng(12), {}
    words = [f"w{i}" for i in range(200)]
    for i in range(60):
        own = list(words)
        for p in rng.choice(200, rng.integers(2, 8), replace=False):
            own[p] = f"x{rng.integers(0, 10**6)}"
        rows[i] = " ".join(own)
    got = near_duplicates.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, 4)
