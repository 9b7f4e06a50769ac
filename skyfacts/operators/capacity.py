"""Seat occupancy over time, by flight and by route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.functions import bitmaps
from skyfacts.functions.aggregates import divide, n_unique
from skyfacts.functions.columns import percent_text
from skyfacts.functions.dates import day_name, iso_weekday

# A flight above the first is full, below the second half empty.
FULL, HALF_EMPTY = 0.9, 0.5


def occupancy(capacity: DataFrame) -> DataFrame:
    """Share of seats sold per flight, not cut at 1, with its date parts.

    A flight without seats has a null share and does not count in means.
    """
    at = F.col("departure")
    return capacity.withColumns(
        {
            "capacity_pct": divide("tickets_sold", "total_capacity"),
            "route_id": F.col("route_code"),
            "week": F.weekofyear(at),
            "month": F.month(at),
            "day_of_week": iso_weekday(at),
            "year_month": F.date_format(at, "yyyy-MM"),
        }
    )


def occupancy_kpis(df: DataFrame) -> DataFrame:
    """Mean and highest share, flight numbers and routes; null is one more of either.

    Rows are added up per flight number and route, and from there per flight
    number: two distinct counts in one aggregate would copy every row.
    """
    pairs = df.groupBy("flight_id", "route_id").agg(
        F.sum("capacity_pct").alias("total"), F.count("capacity_pct").alias("n"), F.max("capacity_pct").alias("high")
    )
    numbers = pairs.groupBy("flight_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("high").alias("high"))
    routes = pairs.select("route_id").distinct().agg(F.count("*")).scalar()
    return numbers.agg(
        divide(F.sum("total"), F.sum("n")).alias("avg_capacity"), F.max("high").alias("max_capacity"), F.count("*").alias("flights")
    ).withColumn("routes", routes)


def _over(df: DataFrame, period: str) -> DataFrame:
    return (
        df.groupBy(period)
        .agg(F.avg("capacity_pct").alias("avg_capacity"), n_unique("flight_id").alias("flights"))
        .orderBy(period)
    )


def by_week(df: DataFrame) -> DataFrame:
    """ISO week number; equal weeks of different years are one row."""
    return _over(df, "week")


def by_month(df: DataFrame) -> DataFrame:
    return _over(df, "year_month")


def by_weekday(df: DataFrame) -> DataFrame:
    return _over(df, "day_of_week").withColumn("day_name", day_name(F.col("day_of_week")))


def daily_states(df: DataFrame, flight_numbers: DataFrame) -> DataFrame:
    """Sum and number of shares, and the set of flight numbers, per day of departure: states that add up.

    `flight_numbers` is a bitmaps.dictionary of flight_id. A day has a row per
    place of its bitmaps. States of different days, files or runs are put
    together by a plain union, also where both have rows of a day.
    """
    per_flight = df.groupBy(F.to_date("departure").alias("day"), "flight_id").agg(
        F.sum("capacity_pct").alias("total"), F.count("capacity_pct").alias("n")
    )
    # Dealt before the bitmaps are made: a page holds few flights of a day in any one task, and each bitmap takes 4 KB.
    placed = bitmaps.numbered(per_flight, "flight_id", flight_numbers).repartition("day", *bitmaps.PLACE)
    return placed.groupBy("day", *bitmaps.PLACE).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), bitmaps.set_of().alias("flight_set")
    )


def by_periods(states: DataFrame) -> DataFrame:
    """Mean share and distinct flight numbers per week, month, weekday and in all, from one reading of daily states.

    `kind` names the report and `period` its value as text, as in by_week,
    by_month and by_weekday; the whole has a null period, and is a row even
    without states.
    """
    day = F.col("day")
    labels = {
        "week": F.weekofyear(day).cast("string"),
        "month": F.date_format(day, "yyyy-MM"),
        "weekday": iso_weekday(day).cast("string"),
        "all": F.lit(None).cast("string"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), label.alias("period")) for kind, label in labels.items()]))
    united = states.select("*", each.alias("at")).groupBy("at.kind", "at.period", *bitmaps.PLACE).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), bitmaps.size_of_union("flight_set").alias("flights")
    )
    whole = states.sparkSession.range(1).select(
        F.lit("all").alias("kind"), F.lit(None).cast("string").alias("period"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("page"),
        F.lit(None).cast("double").alias("total"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("flights"),
    )
    return (
        united.unionByName(whole)
        .groupBy("kind", "period")
        .agg(divide(F.sum("total"), F.sum("n")).alias("avg_capacity"), F.sum("flights").alias("flights"))
        .orderBy("kind", "period")
    )


def by_flight(df: DataFrame) -> DataFrame:
    """Occupancy per flight number; route_id is the smallest of its routes.

    Flights are first added up per route: a minimum of text cannot be hash
    aggregated, so it is taken over the few routes of a flight, not all rows.
    """
    per_route = df.groupBy("flight_id", "route_id").agg(
        F.sum("capacity_pct").alias("total"),
        F.count("capacity_pct").alias("n"),
        F.max("capacity_pct").alias("high"),
        F.min("capacity_pct").alias("low"),
        F.count("departure").alias("seen"),
    )
    return (
        per_route.groupBy("flight_id")
        .agg(
            divide(F.sum("total"), F.sum("n")).alias("avg_capacity"),
            F.max("high").alias("max_capacity"),
            F.min("low").alias("min_capacity"),
            F.min("route_id").alias("route_id"),
            F.sum("seen").alias("observations"),
        )
        .orderBy(F.desc_nulls_first("avg_capacity"), "flight_id")
    )


def top_flights(flights: DataFrame, top: int = 10) -> DataFrame:
    """Fullest flights with the share as text; flights without a share are left out."""
    return (
        flights.dropna(subset=["avg_capacity"])
        .orderBy(F.desc("avg_capacity"), "flight_id")
        .limit(top)
        .select("flight_id", percent_text(F.col("avg_capacity")).alias("avg_capacity"), "route_id")
    )


def by_route(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("route_id")
        .agg(
            F.avg("capacity_pct").alias("avg_capacity"),
            F.max("capacity_pct").alias("max_capacity"),
            n_unique("flight_id").alias("num_flights"),
            F.count("departure").alias("observations"),
        )
        .orderBy(F.desc_nulls_first("avg_capacity"), "route_id")
    )


def top_routes(routes: DataFrame, top: int = 20) -> DataFrame:
    return routes.orderBy(F.desc_nulls_first("avg_capacity"), "route_id").limit(top)


def occupancy_thresholds(df: DataFrame) -> DataFrame:
    """Flight numbers that are full on average, those half empty, and routes seen.

    Both groupings come from one pass over the data.
    """
    both = df.groupingSets([[F.col("flight_id")], [F.col("route_id")]], "flight_id", "route_id").agg(
        F.avg("capacity_pct").alias("mean"), F.grouping("flight_id").alias("other")
    )
    is_flight = F.col("other") == 0
    return both.agg(
        F.count_if(is_flight & (F.col("mean") > FULL)).alias("flights_over_90"),
        F.count_if(is_flight & (F.col("mean") < HALF_EMPTY)).alias("flights_under_50"),
        F.count_if(~is_flight).alias("routes"),
    )
