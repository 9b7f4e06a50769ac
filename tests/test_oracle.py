"""Every registered query gives DuckDB's rows, column names and column types."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from conftest import SF_DIR
from skyfacts.plans import catalogue

QUERIES = {name: contract.queries()[name] for name in catalogue.QUERIES}
ORACLE = {name: contract.oracle_sql()[name] for name in QUERIES}

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_oracle(spark, duck, rows, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    expected = duck.sql(ORACLE[name])
    types = {n: str(t) for n, t in zip(expected.columns, expected.types)}
    assert types == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    listed = ", ".join(f'"{n}"' for n in names)
    wanted = duck.sql(f"select {listed} from ({ORACLE[name]})").fetchall()
    assert rows(df.select(*[f"`{n}`" for n in names])) == sorted(wanted, key=repr)


def test_every_query_has_an_oracle():
    assert all(ORACLE.values())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "avg_tax_pct" in df.columns
