"""Every registered query that has SQL equals it on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from corpuskit.plans import catalog

D = os.environ.get("CORPUSKIT_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("pages", "documents", "embeddings", "conversations", "events")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


SLOW = {"bfs_budget", "bfs_frontier_left", "stream_live_fold"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda rows: sorted(map(repr, rows))
        assert key(plain_rows(got)) == key(plain_rows(want))


def plain_rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v if isinstance(v, str) else float(v)

    return [tuple(map(value, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
