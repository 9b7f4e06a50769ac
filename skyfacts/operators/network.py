"""Routes, fleet and ticket reports over several tables.

Every fact is aggregated by its own key before a join, so each join sees one
row per key however the fact is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.functions.aggregates import divide, sum0
from skyfacts.functions.ranks import above, below, counted_values_at_ranks


def route_revenue(tickets: DataFrame, routes: DataFrame) -> DataFrame:
    """Tickets, revenue and mean ticket value per route; unknown routes keep null ends."""
    per_route = tickets.groupBy("route_code").agg(
        F.count("*").alias("tickets"),
        F.sum("total_amount").alias("amount"),
        F.count("total_amount").alias("priced"),
    )
    return (
        per_route.join(routes.select("route_code", "origin", "destination"), "route_code", "left")
        .select(
            "route_code", "origin", "destination", "tickets",
            F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("revenue"),
            divide("amount", "priced").alias("avg_ticket_value"),
        )
        .orderBy(F.desc("revenue"), "route_code")
    )


def revenue_per_crew_hour(tickets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Revenue per hour of crew time for each route that sold tickets."""
    sold = tickets.groupBy("route_code").agg(F.sum("total_amount").cast("double").alias("revenue"))
    flown = assignments.groupBy("route_code").agg((sum0("flight_minutes") / F.lit(60.0)).alias("crew_hours"))
    return (
        sold.join(flown, "route_code", "left")
        .withColumn("revenue_per_crew_hour", divide("revenue", "crew_hours"))
        .orderBy(F.desc("revenue_per_crew_hour"), "route_code")
    )


def weekly_sales(tickets: DataFrame) -> DataFrame:
    """Tickets and revenue per calendar week, dated by its Monday."""
    week = F.date_trunc("WEEK", "departure").cast("date").alias("week_start")
    return (
        tickets.groupBy(week)
        .agg(F.count("*").alias("tickets"), F.sum("total_amount").cast("double").alias("revenue"))
        .orderBy("week_start")
    )


def route_efficiency(flights: DataFrame, tickets: DataFrame, routes: DataFrame) -> DataFrame:
    """Flights, tickets, revenue per distance and fare per minute for each route."""
    flown = flights.groupBy("route_code").agg(F.count("*").alias("flights"))
    sold = tickets.groupBy("route_code").agg(
        F.count("*").alias("tickets"), F.sum("total_amount").alias("amount")
    )
    fare = divide("amount", "tickets")
    return (
        routes.select("route_code", "origin", "destination", "distance", "flight_minutes")
        .join(flown, "route_code", "left")
        .join(sold, "route_code", "left")
        .select(
            "route_code", "origin", "destination",
            F.col("distance").cast("bigint").alias("distance"),
            F.col("flight_minutes").cast("bigint").alias("flight_minutes"),
            F.coalesce("flights", F.lit(0)).alias("flights"),
            F.coalesce("tickets", F.lit(0)).alias("tickets"),
            F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("revenue"),
            divide("amount", "distance").alias("revenue_per_distance"),
            F.try_divide(fare, F.col("flight_minutes").cast("double")).alias("fare_per_minute"),
        )
        .orderBy(F.desc("revenue_per_distance"), "route_code")
    )


def origin_minutes(flights: DataFrame, routes: DataFrame) -> DataFrame:
    """Flights and their mean duration per origin airport."""
    per_route = flights.groupBy("route_code").agg(F.count("*").alias("n"))
    timed = per_route.join(routes.select("route_code", "origin", "flight_minutes"), "route_code")
    minutes = F.col("flight_minutes").cast("bigint")
    known = F.when(minutes.isNotNull(), F.col("n"))
    return (
        timed.groupBy("origin")
        .agg(F.sum("n").alias("flights"), divide(F.sum(minutes * F.col("n")), F.sum(known)).alias("avg_flight_minutes"))
        .orderBy("origin")
    )


#: Column of the destinations that are not listed.
OTHER = "other"


def city_pairs(revenue: DataFrame) -> DataFrame:
    """Revenue for each pair of origin and destination city (the matrix in long form)."""
    return (
        revenue.groupBy("city", "destination_city")
        .agg(F.sum("revenue").cast("double").alias("total_revenue"))
        .orderBy("city", "destination_city")
    )


def place_matrix(revenue: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Revenue with one column per listed value of the destination place, and one for all others."""
    where = F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(F.lit(OTHER))
    named = revenue.withColumn(column, where)
    return named.groupBy(row).pivot(column, [*values, OTHER]).agg(F.sum("revenue").cast("double")).orderBy(row)


def fleet_use(flights: DataFrame, routes: DataFrame, airplanes: DataFrame, as_of: date) -> DataFrame:
    """Flights, distance, hours, fuel, seats, maintenance and age for each aircraft."""
    legs = flights.groupBy("airplane", "route_code").agg(F.count("*").alias("n"))
    flown = (
        legs.join(routes.select("route_code", "distance", "flight_minutes"), "route_code", "left")
        .groupBy("airplane")
        .agg(
            F.sum("n").alias("flights"),
            sum0(F.col("distance").cast("bigint") * F.col("n")).alias("distance"),
            sum0(F.col("flight_minutes").cast("bigint") * F.col("n")).alias("minutes"),
        )
    )
    minutes = F.coalesce("minutes", F.lit(0))
    return (
        airplanes.withColumnRenamed("aircraft_registration", "airplane")
        .join(flown, "airplane", "left")
        .select(
            "airplane", "model",
            F.coalesce("flights", F.lit(0)).alias("flights"),
            F.coalesce("distance", F.lit(0)).alias("distance"),
            (minutes / F.lit(60.0)).alias("flight_hours"),
            (minutes * F.col("fuel_gallons_hour") / F.lit(60.0)).alias("fuel_gallons"),
            minutes.alias("flight_minutes"),
            F.col("fuel_gallons_hour").cast("bigint").alias("fuel_gallons_hour"),
            _seats().alias("seats"),
            F.col("maintenance_takeoffs").cast("bigint").alias("maintenance_takeoffs"),
            F.col("maintenance_flight_hours").cast("bigint").alias("maintenance_flight_hours"),
            F.floor(F.months_between(F.lit(as_of), F.col("build_date")) / 12).cast("bigint").alias("age_years"),
        )
    )


def _seats():
    return (
        F.col("seats_business").cast("bigint")
        + F.col("seats_premium").cast("bigint")
        + F.col("seats_economy").cast("bigint")
    )


def fuel_by_model(fleet: DataFrame) -> DataFrame:
    """Aircraft, flights, hours and fuel per model."""
    return (
        fleet.groupBy("model")
        .agg(
            F.count("*").alias("aircraft"),
            F.sum("flights").alias("flights"),
            (F.sum("flight_minutes") / F.lit(60.0)).alias("flight_hours"),
            (F.sum(F.col("flight_minutes") * F.col("fuel_gallons_hour")) / F.lit(60.0)).alias("fuel_gallons"),
        )
        .orderBy("model")
    )


def seat_histogram(airplanes: DataFrame, width: int = 10) -> DataFrame:
    """Number of aircraft per model and seat band; a band is named by its lower end."""
    band = (F.floor(_seats() / F.lit(width)) * F.lit(width)).cast("bigint")
    return (
        airplanes.groupBy("model", band.alias("seats_from"))
        .agg(F.count("*").alias("aircraft"))
        .orderBy("model", "seats_from")
    )


def ticket_value_spread(tickets: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the ticket value per class, interpolated.

    The quartiles are exact and are found without sorting a class in one task.
    """
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rules = {f"{name}_{side}": rule(q) for name, q in quarters.items() for side, rule in (("lo", below), ("hi", above))}
    counts = tickets.groupBy("class", F.col("total_amount").alias("_v")).agg(F.count("*").alias("_n"))
    ranks = counted_values_at_ranks(counts, ["class"], rules)
    ends = counts.groupBy("class").agg(
        F.min("_v").cast("double").alias("min_value"),
        F.max("_v").cast("double").alias("max_value"),
        sum0(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("n"),
    )

    def between(name: str, q: float):
        position = F.lit(q) * (F.col("n") - 1)
        part = position - F.floor(position)
        low, high = (F.col(f"{name}_{side}").cast("double") for side in ("lo", "hi"))
        return (low + (high - low) * part).alias(f"{name}_value")

    return (
        ends.join(ranks.withColumnRenamed("class", "_class"), F.col("class").eqNullSafe(F.col("_class")), "left")
        .select("class", "n", "min_value", *[between(name, q) for name, q in quarters.items()], "max_value")
        .orderBy("class")
    )


def tax_by_geography(tickets: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Mean airport tax, tickets and revenue for airports, countries, continents and in all."""
    per_route = tickets.groupBy("route_code").agg(
        F.sum("airport_tax").alias("tax"), F.sum("total_amount").alias("amount"), F.count("*").alias("n")
    )
    per_origin = (
        per_route.join(routes.select("route_code", "origin"), "route_code")
        .groupBy("origin")
        .agg(F.sum("tax").alias("tax"), F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    )
    places = airports.select(F.col("iata_code").alias("origin"), "continent", "country")
    return (
        per_origin.join(places, "origin")
        .rollup("continent", "country", "origin")
        .agg(
            divide(F.sum("tax"), F.sum("n")).alias("avg_airport_tax"),
            F.sum("n").cast("bigint").alias("tickets"),
            F.sum("amount").cast("double").alias("revenue"),
        )
    )


def destination_sales(tickets: DataFrame, routes: DataFrame) -> DataFrame:
    """Tickets and revenue per destination airport."""
    per_route = tickets.groupBy("route_code").agg(F.sum("total_amount").alias("amount"), F.count("*").alias("n"))
    return (
        per_route.join(routes.select("route_code", "destination"), "route_code")
        .groupBy("destination")
        .agg(F.sum("n").cast("bigint").alias("tickets"), F.sum("amount").cast("double").alias("revenue"))
        .orderBy("destination")
    )


def route_tax_burden(tickets: DataFrame, routes: DataFrame, top: int = 20) -> DataFrame:
    """Routes whose taxes take the largest share of what passengers paid."""
    per_route = tickets.groupBy("route_code").agg(
        F.count("*").alias("tickets"),
        F.sum(F.col("airport_tax") + F.col("local_tax")).cast("double").alias("total_tax"),
        F.sum("total_amount").cast("double").alias("revenue"),
    )
    return (
        per_route.join(routes.select("route_code", "origin", "destination"), "route_code", "left")
        .withColumn("tax_share", F.try_divide(F.col("total_tax"), F.col("revenue")))
        .orderBy(F.desc("tax_share"), "route_code")
        .limit(top)
    )
