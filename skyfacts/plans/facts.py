"""Prepared facts: every report reads one of these.

Facts are aggregated by their own key before they meet a dimension, so a hot
route or class is merged map-side and the joins see one row per key. Dimension
joins carry no broadcast hint: Catalyst broadcasts a side whose size estimate
is under the threshold, and adaptive execution splits skewed partitions of the
sort-merge join otherwise.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.schemas import FLIGHT_KEY

KEY = list(FLIGHT_KEY)

# The employee columns of the joined crew table.
CREW_COLUMNS = ("empno", "firstnme", "lastname", "gender", "hiredate", "department", "division")


def _departs_in(window: tuple[datetime, datetime]) -> Column:
    low, high = (F.lit(bound).cast("timestamp_ntz") for bound in window)
    return (F.col("departure") >= low) & (F.col("departure") < high)


AMOUNTS = ("airport_tax", "local_tax", "total_amount")


def ticket_sums(tickets: DataFrame, *keys: str | Column) -> DataFrame:
    """Sums and counts of the amounts, and tickets, per key."""
    return tickets.groupBy(*keys).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in AMOUNTS],
        *[F.count(c).alias(f"{c}_n") for c in AMOUNTS],
        F.count("*").alias("tickets"),
    )


def monthly_ticket_sums(tickets: DataFrame) -> DataFrame:
    """One scan of tickets for both the tax and the revenue fact: sums per month, route and class."""
    return ticket_sums(tickets, F.trunc("departure", "month").alias("at"), "route_code", "class")


def tickets_by_origin(tickets: DataFrame, routes: DataFrame) -> DataFrame:
    """Mean taxes and ticket value, revenue and ticket count per origin airport.

    Sums and counts per route first, then per origin: the means are ratios of
    exact sums, so two stages give the same numbers as one.
    """
    return origin_means(ticket_sums(tickets, "route_code"), routes)


def origin_means(sums: DataFrame, routes: DataFrame) -> DataFrame:
    """tickets_by_origin from sums that hold a route's tickets in any number of rows."""
    parts = [*(f"{c}_{part}" for c in AMOUNTS for part in ("sum", "n")), "tickets"]
    per_route = sums.groupBy("route_code").agg(*[F.sum(c).alias(c) for c in parts]) if "at" in sums.columns else sums

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum").cast("double"), F.sum(f"{name}_n"))

    return (
        per_route.join(routes.select("route_code", "origin"), "route_code")
        .groupBy("origin")
        .agg(
            mean("airport_tax").alias("avg_airport_tax"),
            mean("local_tax").alias("avg_local_tax"),
            mean("total_amount").alias("avg_ticket_value"),
            F.sum("total_amount_sum").cast("double").alias("total_revenue"),
            F.sum("tickets").cast("bigint").alias("ticket_count"),
        )
    )


def revenue_fact(
    tickets: DataFrame,
    routes: DataFrame,
    airports: DataFrame,
    grain: str = "month",
    window: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Revenue per departure (or month), route and class with both geographies.

    Both airport joins are inner: a route whose airport is unknown drops out.
    The month grain adds the departures of a month up before the joins; every
    report sums revenue, so its results are the same from either grain. A
    departure window filters the raw column, where storage can skip data.
    """
    source = tickets.where(_departs_in(window)) if window else tickets
    when = F.trunc("departure", "month") if grain == "month" else F.col("departure").cast("timestamp_ntz")
    sold = source.groupBy(when.alias("at"), "route_code", "class").agg(F.sum("total_amount").alias("revenue"))
    return placed_revenue(sold, routes, airports)


def placed_revenue(sold: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Revenue (at, route_code, class, revenue) with both ends of the route."""

    def place(role: str) -> DataFrame:
        names = {"continent": "continent", "country": "country", "city": "city"}
        prefix = "" if role == "origin" else "destination_"
        return airports.select(F.col("iata_code").alias(role), *[F.col(c).alias(prefix + c) for c in names])

    ends = (
        routes.select("route_code", "origin", "destination")
        .join(place("origin"), "origin")
        .join(place("destination"), "destination")
    )
    return sold.join(ends, "route_code").select(
        F.year("at").cast("bigint").alias("year"),
        F.trunc("at", "month").alias("month"),
        "continent", "country", "city",
        "route_code", "origin", "destination",
        "destination_continent", "destination_country", "destination_city",
        "class", "revenue",
    )


def staff_counts(staff: DataFrame) -> DataFrame:
    return staff.groupBy("department").agg(F.count_distinct("empno").alias("staff_count"))


def staff_assignments(
    flight_crew: DataFrame, routes: DataFrame, staff: DataFrame, unique_crew: bool = False
) -> DataFrame:
    """Distance and minutes per crew assignment; null where the route has none.

    Repeated crew rows are added up by the assignment alone, before the joins;
    routes and staff add one row each by their keys. Crew rows that are known
    to be unique (their declared key, see quality.duplicate_keys) need no
    grouping, which saves a shuffle of the whole table.
    """
    assignment = ["empno", *KEY]
    if unique_crew:
        flown = flight_crew.select(*assignment).withColumn("times", F.lit(1))
    else:
        flown = flight_crew.groupBy(*assignment).agg(F.count("*").alias("times"))
    legs = routes.select("route_code", "distance", "flight_minutes")
    people = staff.select("empno", "firstnme", "lastname", "department")
    return (
        flown.join(legs, "route_code", "left")
        .join(people, "empno", "left")
        .select(
            "firstnme", "lastname", "empno", *KEY, "department",
            (F.col("distance") * F.col("times")).cast("bigint").alias("distance"),
            (F.col("flight_minutes") * F.col("times")).cast("bigint").alias("flight_minutes"),
        )
    )


def crew_used(flight_crew: DataFrame) -> DataFrame:
    """Distinct crew members per flight."""
    return flight_crew.groupBy(*KEY).agg(F.count_distinct("empno").alias("used_crew"))


def staff_usage(
    flights: DataFrame, airplanes: DataFrame, flight_crew: DataFrame, routes: DataFrame
) -> DataFrame:
    """Crew the aircraft requires and crew used, per flight; null where unknown."""
    planes = airplanes.select(
        F.col("aircraft_registration").alias("airplane_reg"),
        F.col("model").alias("airplane_model"),
        F.col("crew_members").cast("bigint").alias("required_crew"),
    )
    return (
        flights.select(*KEY, "airplane")
        .join(crew_used(flight_crew), KEY, "left")
        .join(planes, F.col("airplane") == F.col("airplane_reg"), "left")
        .join(routes.select("route_code", "origin", "destination"), "route_code", "left")
        .select(
            "flight_id", "route_code", "origin", "destination", "departure", "airplane",
            "required_crew", "airplane_model", "airplane_reg", "used_crew",
        )
    )


def capacity(flights: DataFrame, tickets: DataFrame, airplanes: DataFrame, seats: str | None = None) -> DataFrame:
    """Seats sold and seats on board per flight.

    A ticket row is one seat unless a column gives the number of seats. A flight
    without tickets sold 0; one whose aircraft is unknown has a null capacity.
    """
    sold = F.sum(seats) if seats else F.count("*")
    per_flight = tickets.groupBy(*KEY).agg(sold.cast("bigint").alias("tickets_sold"))
    planes = airplanes.select(
        F.col("aircraft_registration").alias("airplane"),
        (
            F.col("seats_business").cast("int") + F.col("seats_premium").cast("int") + F.col("seats_economy").cast("int")
        ).alias("total_capacity"),
    )
    return (
        flights.select(*KEY, "airplane")
        .join(per_flight, KEY, "left")
        .join(planes, "airplane", "left")
        .select(*KEY, F.coalesce("tickets_sold", F.lit(0).cast("bigint")).alias("tickets_sold"), "total_capacity")
    )


def crew_master(
    flight_crew: DataFrame, flights: DataFrame, routes: DataFrame, airplanes: DataFrame, staff: DataFrame
) -> DataFrame:
    """One row per assignment with the flight's, route's, aircraft's and employee's columns."""
    # Crew meets flights by the flight key alone; the flight's route and aircraft are looked up after
    # that shuffle, the narrow employee columns first and the routes, the smallest table, last: each of these
    # joins may shuffle all crew rows. A crew row without a flight has no route here, though it names one; a mark
    # tells that, which takes less room in those shuffles than the route once more.
    planes = airplanes.withColumnRenamed("aircraft_registration", "airplane")
    legs = routes.withColumnRenamed("route_code", "_flown")
    people = staff.select(*[c for c in CREW_COLUMNS if c in staff.columns])
    flown = flight_crew.join(flights.withColumn("_met", F.lit(True)), KEY, "left")
    manned = flown.join(people, "empno", "left").join(planes, "airplane", "left")
    made = manned.withColumn("_flown", F.when(F.col("_met"), F.col("route_code"))).join(legs, "_flown", "left")

    def others(df: DataFrame, *names: str) -> list[str]:
        return [c for c in df.columns if c not in names]

    return made.select(
        "empno", "airplane", *others(flown, "empno", "airplane", "_met"),
        *others(legs, "_flown"), *others(planes, "airplane"), *others(people, "empno"),
    )
