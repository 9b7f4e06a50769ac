"""What the plans must and must not contain, whatever the size of the data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import SF_DIR
from skyfacts import session
from skyfacts.functions import bitmaps
from skyfacts.functions.dates import departure_window
from skyfacts.operators import capacity, profiling, quality, staff
from skyfacts.plans import facts
from skyfacts.plans.airline_views import AirlineViews
from skyfacts.plans.catalogue import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_automatic_broadcast(spark):
    """Plans as they are when no table is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", list(QUERIES))
def test_large_plan(spark, no_automatic_broadcast, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    for unwanted in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoopJoin"):
        assert unwanted not in plan
    assert "BroadcastExchange" not in plan


def test_departure_window_reaches_the_scan(views):
    window = departure_window("1996-03-15", "1999-06-20")
    plan = plan_of(facts.revenue_fact(views.tickets, views.routes, views.airports, window=window))
    assert "GreaterThanOrEqual(l_shipdate,1996-04-01T00:00)" in plan
    assert "LessThan(l_shipdate,1999-07-01T00:00)" in plan


def test_year_range_reaches_the_scan(views):
    usage = facts.staff_usage(views.flights, views.airplanes, views.flight_crew, views.routes)
    plan = plan_of(staff.route_crew_gap(staff.departing_in(usage, 1997, 1999)))
    assert plan.count("GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)") >= 2


@pytest.mark.parametrize("name", ["tax_kpis", "top_countries_tax"])
def test_totals_do_not_sort_their_rows(spark, views, name):
    plan = plan_of(QUERIES[name].build(views))
    assert "rangepartitioning(avg_tax_pct" not in plan


def test_occupancy_totals_copy_no_rows(spark, views):
    assert "Expand" not in plan_of(QUERIES["capacity_kpis"].build(views))


RANGED = ["revenue_total", "revenue_total_default_range", "revenue_top_route", "revenue_top_city", "revenue_trend",
          "revenue_by_class", "revenue_by_country", "revenue_by_location"]


@pytest.mark.parametrize("name", RANGED)
def test_ranged_revenue_reads_the_range_alone(views, name):
    plan = plan_of(QUERIES[name].build(views))
    assert "GreaterThanOrEqual(l_shipdate," in plan and "LessThan(l_shipdate," in plan


def test_crew_meets_flights_before_the_dimensions(views, spark, no_automatic_broadcast):
    """The large join sees neither route nor aircraft columns."""
    master = facts.crew_master(views.flight_crew, views.flights, views.routes, views.airplanes, views.staff)
    lines = master._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line and "flight_id" in line)
    depth = lines[at].index("Join")
    below = [line for line in lines[at + 1 :]]
    end = next((i for i, line in enumerate(below) if len(line) - len(line.lstrip(" :+-")) <= depth), len(below))
    assert end > 0 and not any("build_date" in line or "parent_route" in line for line in below[:end])


def test_only_needed_columns_are_read(views):
    plan = plan_of(facts.tickets_by_origin(views.tickets, views.routes))
    assert "l_orderkey" not in plan and "l_returnflag" not in plan


def test_tickets_are_added_up_before_the_join(views, spark, no_automatic_broadcast):
    """The join sees one row per route: below it is the finished aggregate."""
    plan = plan_of(facts.tickets_by_origin(views.tickets, views.routes))
    join = plan.index("SortMergeJoin")
    assert "partial_sum(total_amount" in plan[join:]
    assert "sum(total_amount_sum" in plan[:join]


def test_text_minimum_is_not_sorted_over_tickets(views):
    assert "SortAggregate" not in plan_of(views.flights)


def test_hot_route_is_split(spark, no_automatic_broadcast):
    """A route with a third of all assignments does not become one task of the join."""
    small = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {key: spark.conf.get(key) for key in small}
    route = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("R"), F.col("id") % 500))
    crew = spark.range(0, 60_000, 1, 8).select(
        F.col("id").cast("int").alias("empno"),
        F.concat(F.lit("F"), F.col("id") % 900).alias("flight_id"),
        route.alias("route_code"),
        F.lit("2021-01-01 00:00:00").cast("timestamp_ntz").alias("departure"),
    )
    legs = spark.range(501).select(
        F.when(F.col("id") == 500, "HOT").otherwise(F.concat(F.lit("R"), F.col("id"))).alias("route_code"),
        F.lit(100).alias("distance"), F.lit(60).cast("smallint").alias("flight_minutes"),
    )
    people = spark.range(60_000).select(
        F.col("id").cast("int").alias("empno"), F.lit("a").alias("firstnme"), F.lit("b").alias("lastname"),
        F.lit("X").alias("department"),
    )
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        made = facts.staff_assignments(crew, legs, people)
        assert len(made.collect()) == 60_000
        assert "skew=true" in plan_of(made)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scans(df, table: str) -> int:
    """Scans of a table in the plan that ran; a reused shuffle is none."""
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    return sum("FileScan" in line and f"/{table}.parquet" in line for line in final.split("\n"))


@pytest.mark.parametrize("name", ["numeric_summary", "numeric_summary_routes", "ticket_value_spread"])
def test_ranked_reports_read_their_rows_once(views, name):
    assert scans(QUERIES[name].build(views), "lineitem") == 1


def test_sketched_profile_reads_its_rows_once(views):
    assert scans(profiling.profile(views.tickets, approx=True), "lineitem") == 1


def test_crew_is_dealt_by_flight_once(views, no_automatic_broadcast):
    """Bookings are shuffled by flight; the crew made of them is not shuffled again for what counts or joins by flight."""
    plan = plan_of(facts.crew_used(views.flight_crew))
    assert plan.count("hashpartitioning(flight_id") == 1 and "hashpartitioning(empno" not in plan
    assert "hashpartitioning(empno" not in plan_of(quality.duplicate_keys(views.flight_crew, ["empno", *facts.KEY]))
    plan = plan_of(facts.crew_master(views.flight_crew, views.flights, views.routes, views.airplanes, views.staff))
    at = [plan.index(f"hashpartitioning({key}") for key in ("_flown", "airplane", "empno")]
    assert at == sorted(at)  # from the top: routes are met last, employees first


def test_sold_flights_are_shuffled_once(views, no_automatic_broadcast):
    """Crew meets flights where these were added up, and carries no second route code through the shuffles after that."""
    plan = plan_of(facts.crew_master(views.flight_crew, views.flights, views.routes, views.airplanes, views.staff))
    assert "Union" in plan and not re.search(r"Exchange hashpartitioning\(flight_id[^\n]*\n[^\n]*Union", plan)
    assert "_met" in plan and not re.search(r"Exchange hashpartitioning\((?:empno|airplane)[^\n]*\n[^\n]*_flown", plan)
    plan = plan_of(facts.staff_usage(views.flights, views.airplanes, views.flight_crew, views.routes))
    assert not re.search(r"Exchange hashpartitioning\(flight_id[^\n]*\n[^\n]*Union", plan)


def test_crew_of_flights_without_an_id(spark, tmp_path):
    """Equal crew rows of different unnamed flights stay apart, equal ones of one flight are one row."""
    spark.sql("select 1L as l_orderkey, id as l_partkey, cast(null as bigint) as l_suppkey, 1 as l_linenumber, 1.0D as l_quantity, "
              "timestamp_ntz'2020-01-01 00:00:00' as l_shipdate from values (1L), (2L), (12L) as t(id)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L as o_orderkey, 5L as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    crew = AirlineViews(spark, str(tmp_path)).flight_crew
    assert [tuple(r)[:3] for r in crew.collect()] == [(5, None, None)] * 2


def test_shuffles_of_reports_grow_with_the_input(spark):
    before = {key: spark.conf.get(key, None) for key in (session.INITIAL_PARTITIONS, *session.REPORT_SETTINGS)}
    try:
        for size, parts in ((0, spark.conf.get("spark.sql.shuffle.partitions")), (4 << 30, "2048")):
            session.tune_reports(spark, size)
            assert spark.conf.get(session.INITIAL_PARTITIONS) == parts
        contract.queries()["crew_used"](spark, SF_DIR)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
        assert spark.conf.get(session.INITIAL_PARTITIONS) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(("made", "times"), [(profiling.profile, 2), (profiling.describe, 5)])
def test_profiles_look_passengers_up_twice(views, made, times):
    """Once for what is counted in all rows, once for the passengers or for all values, which four passes read from one shuffle."""
    assert plan_of(made(views.passenger_tickets)).count("/orders.parquet") == times


def test_references_of_one_table_share_its_counts(spark):
    tickets = spark.range(0, 60, 1, 7).selectExpr("id as passenger_id", "concat('F', id % 9) as flight_id", "if(id % 5 = 0, null, concat('R', id % 4)) as route_code", "timestamp_ntz'2020-01-01 00:00:00' as departure")
    known = spark.sql("select 'F1' as flight_id, 'R1' as route_code, timestamp_ntz'2020-01-01 00:00:00' as departure")
    report = quality.declared_reference_report({"tickets": tickets, "flights": known, "routes": known.select("route_code", F.lit("A").alias("origin"), F.lit("A").alias("destination"), F.lit("R1").alias("parent_route"))})
    found = {(r["table"], r["columns"]): (r["n_missing"], r["n_rows"]) for r in report.collect()}
    assert plan_of(report).split("== Initial Plan ==")[0].count("splits=7") == 1
    flight = ["flight_id", "route_code", "departure"]
    kept = tickets.where("route_code is not null")
    assert found["tickets", "route_code"] == (3, kept.where("route_code <> 'R1'").count())
    missing = kept.where("not (flight_id = 'F1' and route_code = 'R1')")
    assert found["tickets", ", ".join(flight)] == (missing.select(*flight).distinct().count(), missing.count())


def test_days_are_dealt_before_their_bitmaps(spark, views, monkeypatch):
    df = capacity.occupancy(facts.capacity(views.flights, views.tickets, views.airplanes, seats="seats"))
    plan = plan_of(capacity.daily_states(df, bitmaps.dictionary(views.flights, "flight_id")))
    assert plan.index("partial_bitmap_construct_agg") < plan.index("hashpartitioning(day")
    large = AirlineViews(spark, SF_DIR)
    large.input_bytes = 10 * bitmaps.BYTES_PER_PART
    asked, made = [], bitmaps.dictionary
    monkeypatch.setattr(bitmaps, "dictionary", lambda *args, parts: asked.append(parts) or made(*args, parts=parts))
    QUERIES["capacity_by_periods"].build(large)
    QUERIES["capacity_by_periods"].build(views)
    assert asked == [10, bitmaps.PARTS]
