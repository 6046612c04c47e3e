"""Operators with SQL against that SQL, over whole tables."""

import duckdb
import pytest

from foldtable.llm.queries import ORACLE_SQL, QUERIES

from .data import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(names) and want
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.select(*names).collect())
