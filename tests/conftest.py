"""One Spark session, one DuckDB connection and the views for all tests."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skyfacts.plans.airline_views import SOURCE_SCHEMAS, AirlineViews  # noqa: E402
from skyfacts.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, app="tests")
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return AirlineViews(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in SOURCE_SCHEMAS:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of plain tuples."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
