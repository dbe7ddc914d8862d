"""The training-text queries on the smallest tables: columns, SQL where there is some, brute force elsewhere."""

from __future__ import annotations

from pathlib import Path

import pytest

from orefold.llm import queries
from tests.llm import test_history

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test data here")
COLUMNS = {"p2_found": ["keep_id", "copy_id"], "p6_found": ["old_id", "new_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    assert df.columns == COLUMNS.get(name, df.columns) and len(df.collect()) > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "eval_items", "corpus_entries"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = sorted(map(tuple, queries.QUERIES[name](spark, str(FOLDER)).collect()))
    assert got == sorted(con.execute(queries.SQL[name]).fetchall())


def test_repeats_agree_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/violations.parquet").select(*test_history.ARGS).collect()]
    assert sorted(map(tuple, queries.p6_found(spark, str(FOLDER)).collect())) == test_history.brute(rows)
