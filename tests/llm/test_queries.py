"""Every corpus query with SQL equals its oracle."""

import os

import duckdb
import pytest

from gossamer.llm import catalogue as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(repr([str(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(C.ORACLES))
def test_query(spark, duck, name):
    assert plain(C.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(C.ORACLES[name]).df())
