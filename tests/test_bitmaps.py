"""Distinct counts from bitmaps against counting the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfacts.functions import bitmaps
from skyfacts.operators import capacity
from skyfacts.plans import facts
from test_plans import plan_of


def occupancy(views):
    return capacity.occupancy(facts.capacity(views.flights, views.tickets, views.airplanes, seats="seats"))


def rounded(df, *names):
    return df.select(*names, F.round("avg_capacity", 9).alias("avg_capacity"), "flights")


def test_periods_equal_the_single_reports(views, rows):
    df = occupancy(views)
    states = capacity.daily_states(df, bitmaps.dictionary(views.flights, "flight_id"))
    found = capacity.by_periods(states)
    single = {"week": (capacity.by_week(df), "week"), "month": (capacity.by_month(df), "year_month"), "weekday": (capacity.by_weekday(df), "day_of_week")}
    for kind, (report, label) in single.items():
        report = report.withColumn("period", F.col(label).cast("string"))
        assert rows(rounded(found.where(F.col("kind") == kind), "period")) == rows(rounded(report, "period"))
    (whole,) = found.where("kind = 'all'").collect()
    kpis = capacity.occupancy_kpis(df).first()
    assert whole.flights == kpis.flights and abs(whole.avg_capacity - kpis.avg_capacity) < 1e-9


def test_periods_scan_flights_and_tickets_as_often_as_one_report(spark, views):
    df = occupancy(views)
    once = plan_of(capacity.by_week(df)).count("FileScan")
    kept = spark.createDataFrame([], "value string, part int, nth bigint")
    states = capacity.daily_states(df, kept)
    assert plan_of(capacity.by_periods(states)).count("FileScan") == once


def test_states_of_parts_add_up_with_a_growing_dictionary(spark, rows):
    schema = "flight_id string, route_code string, departure timestamp, tickets_sold bigint, total_capacity int"
    raw = [(f"F{i % 700}" if i % 11 else None, "R", None if i % 13 == 0 else f"2024-0{1 + i % 9}-0{1 + i % 7} 08:00:00", i % 5, i % 3 * 2) for i in range(3000)]
    df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in raw], schema.replace("timestamp", "string")).withColumn("departure", F.to_timestamp("departure"))
    df = capacity.occupancy(df)
    early, late = (df.where(F.coalesce(F.month("departure"), F.lit(1)) <= 4), df.where(F.month("departure") >= 4))
    first = bitmaps.dictionary(early, "flight_id", parts=3)
    both = bitmaps.dictionary(late, "flight_id", known=first, parts=3)
    assert set(rows(first)) <= set(rows(both))
    assert both.count() == both.select("part", "nth").distinct().count() == df.select("flight_id").distinct().count()
    april = F.month("departure") == 4  # rows of these days are in both parts: counted once in sets, twice in sums
    states = capacity.daily_states(early, first).unionByName(capacity.daily_states(late.where(~april), both))
    want = capacity.by_periods(capacity.daily_states(df, bitmaps.dictionary(df, "flight_id")))
    assert rows(rounded(capacity.by_periods(states), "kind", "period")) == rows(rounded(want, "kind", "period"))
    twice = capacity.by_periods(states.unionByName(states))
    assert rows(twice.select("kind", "period", "flights")) == rows(want.select("kind", "period", "flights"))


def test_more_than_a_page_and_nothing(spark):
    many = spark.range(100_000).select(F.col("id").cast("string").alias("flight_id"))
    placed = bitmaps.numbered(many.unionByName(many), "flight_id", bitmaps.dictionary(many, "flight_id", parts=2))
    sets = placed.groupBy(*bitmaps.PLACE).agg(bitmaps.set_of().alias("bits"))
    assert sets.count() == 4
    assert sets.groupBy(*bitmaps.PLACE).agg(bitmaps.size_of_union().alias("n")).agg(F.sum("n")).first()[0] == 100_000
    none = spark.createDataFrame([], "flight_id string, departure timestamp, capacity_pct double")
    found = capacity.by_periods(capacity.daily_states(none, bitmaps.dictionary(none, "flight_id"))).collect()
    assert [tuple(r) for r in found] == [("all", None, None, 0)]
