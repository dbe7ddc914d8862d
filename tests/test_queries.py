"""Every core query with SQL against DuckDB on the smallest tables, and the others for their columns."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from orefold.queries import problems, reference

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test data here")
QUERIES = problems.QUERIES | reference.QUERIES
SQL = problems.SQL | reference.SQL


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, str(FOLDER)).collect()) > 0


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["producer", "file_seq", "change_kind", "old_path", "new_path"]
