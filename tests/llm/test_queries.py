"""The registered queries of near duplicates and byte-pair encoding, against plain versions on ``documents``."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
from tests.llm.test_llm import SF

from sparkforest.llm import _util, bpe, queries
from sparkforest.operators import train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}


def test_near_duplicate_query(spark, documents):
    """All pairs, compared on full sets; the smallest id of each component."""
    sets = [shingles(t) for _, t in documents]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    top[y], links = x, links + 1
    assert links > 5
    want = sorted((key, len(s), documents[root(i)][0], root(i) == i) for i, ((key, _), s) in enumerate(zip(documents, sets)))
    got = queries.queries()["op5_setsketch"](spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want


def test_byte_pair_query(spark, documents):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for key, text in documents:
        ids = encoding.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = queries.queries()["op9_bpe_roundtrip"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


class Session:
    """What the scratch folder asks of a session: no checkpoint folder, a warehouse, a master."""

    def __init__(self, warehouse, master):
        self.warehouse, self.master, self.conf, self.sparkContext = warehouse, master, self, self

    def get(self, name, default=None):
        return self.warehouse if name == "spark.sql.warehouse.dir" else default

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("folder", [_util.scratch_path, train.scratch])
def test_scratch_is_never_a_folder_of_the_driver_alone(folder):
    for warehouse in ("/tmp/warehouse", "file:/tmp/warehouse"):
        with pytest.raises(ValueError, match="share"):
            folder(Session(warehouse, "spark://host:7077"))
        assert folder(Session(warehouse, "local[4]")).startswith(warehouse)
    assert folder(Session("hdfs://name/warehouse", "yarn")).startswith("hdfs://name/warehouse/")
