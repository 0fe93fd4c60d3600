"""Every registered query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from voxmill.llm import queries

DATA = os.environ.get("VOXMILL_TEST_DATA", "/root/testdata/sf0.001")


def _plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(_plain, r)) for r in frame.select(*columns).collect()), key=str) == want
