"""Facts of flights over bucketed tables: the same rows, without a shuffle below the flight join."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from skyfacts.plans import colocated, facts
from test_plans import no_automatic_broadcast, plan_of  # noqa: F401

BUCKETS = 8


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"create database colocated location '{tmp_path}'")
    yield "colocated"
    spark.sql("drop database colocated cascade")


def raw(views):
    return {"flights": views.flights, "flight_crew": views.flight_crew, "tickets": views.tickets}


def built(views, tables, seats):
    return {
        "staff_usage": facts.staff_usage(tables["flights"], views.airplanes, tables["flight_crew"], views.routes),
        "capacity": facts.capacity(tables["flights"], tables["tickets"], views.airplanes, seats),
        "crew_master": facts.crew_master(tables["flight_crew"], tables["flights"], views.routes, views.airplanes, views.staff),
    }


def by_flight(plan):
    return re.findall(r"Exchange hashpartitioning\(flight_id[^\n]*", plan)


def test_no_shuffle_below_the_flight_join(spark, views, rows, database, no_automatic_broadcast):  # noqa: F811
    found = colocated.colocate(raw(views), database, seats="seats", buckets=BUCKETS)
    assert found.keys() == colocated.NAMES.keys() and all(1 <= skew <= colocated.MOST_SKEW for skew in found.values())
    plain = built(views, raw(views), "seats")
    placed = built(views, colocated.read(spark, database), colocated.SOLD)
    for name, df in placed.items():
        assert by_flight(plan_of(plain[name])) and not by_flight(plan_of(df)), name
        assert f"SelectedBucketsCount: {BUCKETS} out of {BUCKETS}" in df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        assert rows(df) == rows(plain[name])


def test_hot_flight_is_left_to_adaptive_joins(spark, views, rows, database, no_automatic_broadcast):  # noqa: F811
    one = views.flight_crew.orderBy(*views.flight_crew.columns).limit(1)
    copies = one.crossJoin(spark.range(3 * views.flight_crew.count())).drop("id")
    hot = raw(views) | {"flight_crew": views.flight_crew.unionByName(copies)}
    found = colocated.colocate(hot, database, buckets=BUCKETS)
    assert found["flight_crew"] > colocated.MOST_SKEW > found["flights"]
    tables = colocated.read(spark, database)
    plain, placed = built(views, hot, None), built(views, tables, colocated.SOLD)
    assert by_flight(plan_of(placed["staff_usage"])) and not by_flight(plan_of(placed["capacity"]))
    for name in ("staff_usage", "capacity"):
        assert rows(placed[name]) == rows(plain[name])


def test_bucket_sizes_are_those_of_the_files(spark, views, rows, database):
    colocated.colocate(raw(views), database, buckets=BUCKETS)
    saved = spark.table(f"{database}.{colocated.NAMES['flights']}")
    bucket = F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1).cast("int").alias("bucket")
    assert rows(saved.groupBy(bucket).agg(F.count("*").alias("n"))) == rows(colocated.bucket_sizes(views.flights, BUCKETS))


def test_empty_tables(spark, views, database):
    empty = {name: df.limit(0) for name, df in raw(views).items()}
    assert set(colocated.colocate(empty, database, buckets=BUCKETS).values()) == {0.0}
    assert colocated.read(spark, database)["tickets"].columns == [*facts.KEY, colocated.SOLD]
    assert built(views, colocated.read(spark, database), colocated.SOLD)["capacity"].collect() == []
