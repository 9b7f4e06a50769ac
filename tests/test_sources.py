"""Readers, writers, catalog and the preparation job, round trip."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyfacts.operators import capacity, passengers, revenue, staff, tax
from skyfacts.plans import facts, prepare
from skyfacts.sources import catalog, prepared, sinks, tables

RAW = ("airports", "routes", "airplanes", "flights", "flight_crew", "staff", "passengers")
# Declared columns that the test views do not have.
ABSENT = {
    "flights": ["frequency", "arrival", "price_premium", "price_business"],
    "staff": ["midinit", "passport", "birthdate", "division", "marital_status", "phone", "email"],
    "tickets": ["seat"], "passengers": ["lastname", "gender"],
}
DATASETS = [
    "tickets_agg", "airports", "revenue", "q1_staff_counts", "q2_staff_assignments", "q3_staff_usage", "capacity", "passenger_sales",
]


@pytest.fixture(scope="module")
def raw_folder(views, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for name in RAW:
        getattr(views, name).write.parquet(f"{root}/{name}")
    views.passenger_tickets.write.parquet(f"{root}/tickets")
    return root


@pytest.fixture(scope="module")
def ready(spark, raw_folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("prepared"))
    written = prepare.prepare(seat_tables(spark, raw_folder), root, seats="seats")
    assert written == DATASETS
    return root


def seat_tables(spark, root):
    """Raw tables with the column that gives a ticket's seats."""
    return prepare.read_raw(spark, root, extra={"tickets": ["seats"]}, absent=ABSENT)


def test_prepared_reports_equal_direct_ones(spark, views, ready, rows):
    read = prepared.require_inputs(spark, ready, DATASETS)
    direct = tax.airport_tax_report(facts.tickets_by_origin(views.tickets, views.routes), views.airports)
    assert rows(tax.airport_tax_report(read["tickets_agg"], read["airports"])) == rows(direct)
    fact = revenue.normalize_revenue(facts.revenue_fact(views.tickets, views.routes, views.airports, grain="departure"))
    again = revenue.normalize_revenue(read["revenue"])
    span = ("1995-01-01", "2002-01-01")
    for report in (revenue.total_revenue, revenue.top_route, revenue.top_city, revenue.monthly_revenue, revenue.revenue_by_class, revenue.revenue_by_country):
        assert rows(report(again, *span)) == rows(report(fact, *span))
    usage = facts.staff_usage(views.flights, views.airplanes, views.flight_crew, views.routes)
    assert rows(staff.route_crew_gap(read["q3_staff_usage"])) == rows(staff.route_crew_gap(usage))
    direct_capacity = facts.capacity(views.flights, views.tickets, views.airplanes, seats="seats")
    assert rows(capacity.occupancy(read["capacity"]).select("flight_id", "capacity_pct")) == rows(
        capacity.occupancy(direct_capacity).select("flight_id", "capacity_pct")
    )
    sales = passengers.passenger_sales(views.passenger_tickets, views.passengers)
    assert rows(passengers.by_country(read["passenger_sales"])) == rows(passengers.by_country(sales))
    counts = prepare.report_counts(spark, ready, ["capacity"])
    assert counts["capacity"].first().n_rows == direct_capacity.count()


def test_year_folders_are_pruned(spark, ready):
    one_year = spark.read.parquet(f"{ready}/q2_staff_assignments").where("departure_year = 1998")
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departure_year" in plan
    usage = staff.departing_in(spark.read.parquet(f"{ready}/q3_staff_usage"), 1997, 1999)
    assert "(departure_year#" in usage._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]


def test_revenue_reads_only_the_years_of_the_range(spark, ready, rows):
    span = ("1997-03-15", "1998-02-10")
    cut, whole = prepare.read_revenue(spark, ready, *span), prepare.read_revenue(spark, ready)
    assert rows(revenue.monthly_revenue(cut, *span)) == rows(revenue.monthly_revenue(whole, *span))
    assert cut.agg(F.min("year"), F.max("year")).first() == (1997, 1998)
    assert "PartitionFilters: [isnotnull(year" in cut._jdf.queryExecution().executedPlan().toString()


def test_sums_agree_across_reports(views):
    fact = revenue.normalize_revenue(facts.revenue_fact(views.tickets, views.routes, views.airports))
    span = ("1996-01-01", "1999-12-31")
    total = revenue.total_revenue(fact, *span).first().total_revenue
    for report in (revenue.revenue_by_class, revenue.revenue_by_country, revenue.monthly_revenue):
        assert report(fact, *span).agg(F.sum("total_revenue")).first()[0] == pytest.approx(total, rel=1e-12)


def test_tickets_are_scanned_once_for_tax_and_revenue(spark, raw_folder, ready):
    stored = spark.read.parquet(f"{ready}/{prepare.SHARED}")
    built = prepare.datasets(seat_tables(spark, raw_folder), "seats", stored)
    for name in ("tickets_agg", "revenue"):
        assert f"{raw_folder}/tickets" not in built[name]()._jdf.queryExecution().toString()


def test_one_year_is_refreshed_alone(spark, raw_folder, tmp_path, rows):
    raw = seat_tables(spark, raw_folder)
    root = str(tmp_path)
    prepare.prepare(raw, root, seats="seats")
    before = {name: rows(spark.read.parquet(f"{root}/{name}")) for name in prepare.DATED}
    files = set(os.listdir(f"{root}/capacity/departure_year=1996"))
    assert prepare.refresh_years(raw, root, 1997, 1997, seats="seats") == list(prepare.DATED)
    assert {name: rows(spark.read.parquet(f"{root}/{name}")) for name in prepare.DATED} == before
    assert set(os.listdir(f"{root}/capacity/departure_year=1996")) == files


def test_built_on_demand_lies_in_year_folders(spark, raw_folder, tmp_path):
    prepare.prepared_or_built(spark, seat_tables(spark, raw_folder), str(tmp_path), "q3_staff_usage")
    assert "departure_year=1997" in os.listdir(f"{tmp_path}/q3_staff_usage")


def test_unfinished_inputs_are_missing(spark, tmp_path):
    sinks.write_parquet(spark.range(3), f"{tmp_path}/half")
    os.remove(f"{tmp_path}/half/_SUCCESS")
    with pytest.raises(prepared.MissingInputs, match="half"):
        prepared.require_inputs(spark, str(tmp_path), ["half"])


def test_smoke_run_limits_each_query(spark, raw_folder):
    built = prepare.datasets(seat_tables(spark, raw_folder), "seats")
    shown = prepare.smoke_run({name: built[name] for name in ("q1_staff_counts", "q3_staff_usage")}, rows=7)
    assert {name: df.count() for name, df in shown.items()}["q3_staff_usage"] == 7


def test_prepared_or_built(spark, raw_folder, tmp_path):
    raw = seat_tables(spark, raw_folder)
    first = prepare.prepared_or_built(spark, raw, str(tmp_path), "q1_staff_counts")
    assert first.count() == 6
    assert prepared.exists(spark, f"{tmp_path}/q1_staff_counts")


def test_materialize_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert prepared.materialize(spark, f"{tmp_path}/x", build).count() == 3
    assert built == [1]


def test_unfinished_data_is_not_replaced(spark, tmp_path):
    sinks.write_parquet(spark.range(3), f"{tmp_path}/x")
    os.remove(f"{tmp_path}/x/_SUCCESS")
    with pytest.raises(prepared.UnfinishedDataset):
        prepared.materialize(spark, f"{tmp_path}/x", lambda: spark.range(5))
    assert spark.read.parquet(f"{tmp_path}/x").count() == 3


def test_missing_inputs_are_named(spark, tmp_path):
    sinks.write_parquet(spark.range(1), f"{tmp_path}/have")
    with pytest.raises(prepared.MissingInputs, match="lack"):
        prepared.require_inputs(spark, str(tmp_path), ["have", "lack"])


def test_extract_follows_the_manifest(spark, tmp_path):
    source = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "`EMP NO` int, NAME string, PAY double")
    prepared.extract({"t": source}, str(tmp_path), {"t": (["emp no", "pay"], "NAME = 'y'")})
    found = spark.read.parquet(f"{tmp_path}/t")
    assert found.columns == ["emp_no", "pay"] and [tuple(r) for r in found.collect()] == [(2, 3.0)]
    prepared.export_clean(source, f"{tmp_path}/clean")
    assert spark.read.parquet(f"{tmp_path}/clean").columns == ["emp_no", "name", "pay"]


def test_read_table(spark):
    source = spark.createDataFrame([(1, "x"), (2, "y")], "A int, B string")
    assert tables.read_table(source, ["b"], "a > 1").collect()[0].b == "y"
    assert tables.read_table(source).columns == ["a", "b"]
    with pytest.raises(ValueError, match="nope"):
        tables.read_table(source, ["nope"])
    assert tables.quoted("a`b") == "`a``b`"
    assert tables.preview(source, 1).count() == 1 and tables.count_rows(source).first().n_rows == 2


def test_read_sql_binds_parameters(spark):
    found = tables.read_sql(spark, "select :v as ` Value ` where :v > 1", {"v": 5})
    assert found.columns == ["value"] and found.first().value == 5


def test_csv_round_trip(spark, tmp_path):
    source = spark.createDataFrame([("A", 1.5), ("B", None)], "`IATA` string, `Avg Total Tax ($)` double")
    sinks.export_csv(source, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == source.columns and sorted(r.IATA for r in back.collect()) == ["A", "B"]


def test_write_by_year(spark, tmp_path):
    source = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2021, 1, 1))], "id int, departure timestamp_ntz")
    sinks.write_by_year(source, f"{tmp_path}/y", "departure_year", "departure")
    assert {r.departure_year for r in spark.read.parquet(f"{tmp_path}/y").collect()} == {2020, 2021}


def test_refresh_drops_years_without_rows(spark, tmp_path):
    source = spark.createDataFrame([(i, datetime(2020 + i, 1, 1)) for i in range(4)], "id int, departure timestamp_ntz")
    path = f"{tmp_path}/y"
    sinks.write_by_year(source, path, "departure_year", "departure")
    moved = source.where("id = 2")
    sinks.write_by_year(moved, path, "departure_year", "departure", refresh=True, years=range(2021, 2024))
    assert sorted((r.id, r.departure_year) for r in spark.read.parquet(path).collect()) == [(0, 2020), (2, 2022)]


def test_jdbc_options():
    url = "jdbc:db2://host/db"
    whole = tables.jdbc_options(url, table="S.T", properties={"user": "u"})
    assert whole["dbtable"] == "S.T" and whole["user"] == "u" and "numPartitions" not in whole
    sliced = tables.jdbc_options(url, query="select 1", partition_column="id", lower_bound=0, upper_bound=9, partitions=3)
    assert sliced["dbtable"] == "(select 1) q" and sliced["numPartitions"] == "3"
    with pytest.raises(ValueError):
        tables.jdbc_options(url)
    with pytest.raises(ValueError):
        tables.jdbc_options(url, table="T", partitions=3)


def test_catalog(spark):
    context = catalog.session_context(spark).first()
    assert context.current_schema == "default"
    spark.range(1).createOrReplaceTempView("seen_view")
    listed = catalog.list_tables(spark)
    assert ("seen_view", "V") in {(r.table_name, r.table_type) for r in listed.collect()}
    dictionary = spark.createDataFrame(
        [("APP ", "B ", "T"), ("APP ", "A", "V"), ("SYSCAT", "T", "V"), ("NULLID  ", "T", "T"), ("APP", "S", "S")],
        "tabschema string, tabname string, type string",
    )
    users = catalog.user_tables(dictionary)
    assert [tuple(r) for r in users.collect()] == [("APP", "A", "V"), ("APP", "B", "T")]
    assert [tuple(r) for r in catalog.objects_by_schema(users).collect()] == [("APP", "T", 1), ("APP", "V", 1)]


def test_shared_frame_is_kept(spark):
    kept = prepared.shared(spark.range(3))
    assert kept.is_cached
    kept.unpersist()
