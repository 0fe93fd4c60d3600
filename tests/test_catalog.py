"""Every query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from voxmill import catalog

DATA = os.environ.get("VOXMILL_TEST_DATA", "/root/testdata/sf0.001")


def _plain(v):
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sql, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = sql.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(map(_plain, r)) for r in frame.select(*columns).collect()), key=key)
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
