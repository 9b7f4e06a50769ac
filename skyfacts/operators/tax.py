"""Tax burden and ticket prices by airport and country."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.functions.aggregates import sum0
from skyfacts.functions.columns import option_values, where_in

# Headings of the published table.
TABLE_HEADINGS = {
    "origin": "IATA",
    "origin_airport": "Airport",
    "origin_city": "City",
    "origin_country": "Country",
    "origin_continent": "Continent",
    "ticket_count": "Tickets",
    "avg_airport_tax": "Avg Airport Tax ($)",
    "avg_local_tax": "Avg Local Tax ($)",
    "avg_total_tax": "Avg Total Tax ($)",
    "avg_tax_pct": "Tax % of Ticket",
    "avg_ticket_value": "Avg Ticket Value ($)",
}


def origin_places(airports: DataFrame) -> DataFrame:
    """Airports in the role of origin; the names are fixed values of the report."""
    return airports.select(
        F.col("iata_code").alias("origin"),
        F.col("airport").alias("origin_airport"),
        F.col("city").alias("origin_city"),
        F.col("country").alias("origin_country"),
        F.col("continent").alias("origin_continent"),
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
    )


def airport_tax_report(tickets_agg: DataFrame, airports: DataFrame) -> DataFrame:
    """Tax burden per origin airport, highest share of the price first."""
    return airport_tax(tickets_agg, airports).orderBy(F.desc_nulls_first("avg_tax_pct"), "origin")


def airport_tax(tickets_agg: DataFrame, airports: DataFrame) -> DataFrame:
    """Tax burden per origin airport in no order: what filters and totals start from.

    Origins without an airport row stay, with null geography. The names of the
    measures are fixed values of the report.
    """
    means = ("avg_airport_tax", "avg_local_tax", "avg_ticket_value", "total_revenue")
    typed = tickets_agg.select(
        "origin", *[F.col(c).cast("double").alias(c) for c in means], F.col("ticket_count").cast("bigint")
    )
    total_tax = F.col("avg_airport_tax") + F.col("avg_local_tax")
    return (
        typed.join(origin_places(airports), "origin", "left")
        .withColumns(
            {
                "avg_total_tax": total_tax,
                "avg_tax_pct": F.try_divide(total_tax, F.col("avg_ticket_value")) * 100,
            }
        )
    )


def filter_tax(
    report: DataFrame,
    continents: Iterable[str] | None = None,
    countries: Iterable[str] | None = None,
    tax_range: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """Airports of the chosen continents and countries within a tax share range.

    An empty choice means all known places; an open bound does not cut.
    """
    chosen = where_in(where_in(report, "origin_continent", continents), "origin_country", countries)
    low, high = tax_range
    share = F.col("avg_tax_pct")
    chosen = chosen.where(share.isNotNull())
    if low is not None:
        chosen = chosen.where(share >= low)
    if high is not None:
        chosen = chosen.where(share <= high)
    return chosen


def country_options(report: DataFrame, continents: Iterable[str] | None = None) -> DataFrame:
    """Countries to choose from, given the chosen continents."""
    return option_values(where_in(report, "origin_continent", continents), "origin_country")


def tax_bound(report: DataFrame) -> DataFrame:
    """Largest tax share, to one decimal, as the upper end of a range control."""
    return report.agg(F.round(F.max("avg_tax_pct"), 1).alias("max_tax_pct"))


def tax_kpis(report: DataFrame) -> DataFrame:
    """Tickets, mean tax and tax share over airports, and number of airports.

    The means count every airport once; the weighted share counts every ticket.
    """
    return report.agg(
        sum0("ticket_count").alias("total_tickets"),
        F.avg("avg_total_tax").alias("avg_total_tax"),
        F.avg("avg_tax_pct").alias("avg_tax_pct"),
        F.count("*").alias("airports"),
        F.try_divide(
            F.sum(F.col("avg_total_tax") * F.col("ticket_count")),
            F.sum(F.col("avg_ticket_value") * F.col("ticket_count")),
        ).alias("weighted_tax_share"),
    )


def located(report: DataFrame) -> DataFrame:
    """Airports with coordinates."""
    return report.dropna(subset=["lat", "lon"])


def top_airports_by_tax(report: DataFrame, top: int = 15) -> DataFrame:
    """Airports with the largest tax taken: mean tax times tickets."""
    taken = F.col("avg_total_tax") * F.col("ticket_count")
    return (
        report.withColumn("total_tax_collected", taken)
        .orderBy(F.desc_nulls_first("total_tax_collected"), "origin")
        .limit(top)
    )


def top_countries_by_tax(report: DataFrame, top: int = 15) -> DataFrame:
    """Countries with the highest mean tax share over their airports."""
    return (
        report.groupBy("origin_country", "origin_continent")
        .agg(
            F.avg("avg_tax_pct").alias("avg_tax_pct"),
            sum0("ticket_count").alias("ticket_count"),
            F.avg("avg_ticket_value").alias("avg_ticket_value"),
        )
        .orderBy(F.desc_nulls_first("avg_tax_pct"), "origin_country", "origin_continent")
        .limit(top)
    )


def airport_tax_table(report: DataFrame) -> DataFrame:
    """The report under its published headings."""
    return report.select(*[F.col(name).alias(heading) for name, heading in TABLE_HEADINGS.items()])
