import math

import duckdb
import pytest

import __spark_entry__
from sparkforest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return str(v) if isinstance(v, bool) or not hasattr(v, "__float__") else f"{float(v):.9g}"


def rows(pdf):
    return sorted(tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


# lineitem's integer keys collide once at this size, so queries that order by them aren't compared here.
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"head_accuracy", "dense_payload_pack"}))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = {r["split"]: r for r in __spark_entry__.entry(spark).collect()}
    assert set(out) == {"train", "validation", "test"} and out["test"]["accuracy"] > 0.8
