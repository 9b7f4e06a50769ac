"""Every registered SQL text against its query."""

from __future__ import annotations

import duckdb
import pytest

from skyfacts.llm.queries import SQL
from tests.llm.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, query):
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        base.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = base.sql(SQL[name])
    want = sorted((repr(tuple(dict(zip(found.columns, r))[c] for c in sorted(found.columns))) for r in found.fetchall()))
    rows = query(name)
    assert sorted(repr(tuple(r[c] for c in sorted(found.columns))) for r in rows) == want and len(want) > 0
