"""Passenger segments, in aggregate only: no name or contact leaves these reports.

Tickets are added up per passenger and class before the join, so a passenger
who holds a large part of all tickets is one row in it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.functions.aggregates import divide, share_of_all

# Lower ends of the age bands.
AGE_BANDS = (0, 18, 30, 45, 60)


def passenger_sales(tickets: DataFrame, passengers: DataFrame) -> DataFrame:
    """Tickets and amount per passenger and class, with the passenger's segment columns.

    Tickets of an unknown passenger stay, in a segment of their own with null columns.
    """
    sold = tickets.groupBy("passenger_id", "class").agg(
        F.count("*").alias("tickets"), F.sum("total_amount").alias("amount")
    )
    return _with_segments(sold, passengers)


def monthly_passenger_sums(tickets: DataFrame) -> DataFrame:
    """passenger_sales by month, as states that add up: one scan of a month's tickets gives that month's."""
    return tickets.groupBy(F.trunc("departure", "month").alias("at"), "passenger_id", "class").agg(
        F.count("*").alias("tickets"), F.sum("total_amount").alias("amount")
    )


def sales_of_months(months: DataFrame, passengers: DataFrame) -> DataFrame:
    """passenger_sales, merged from monthly states; the amount keeps the states' precision."""
    amount = F.sum("amount").cast(months.schema["amount"].dataType)
    return _with_segments(months.groupBy("passenger_id", "class").agg(F.sum("tickets").alias("tickets"), amount.alias("amount")), passengers)


def _with_segments(sold: DataFrame, passengers: DataFrame) -> DataFrame:
    who = passengers.select(F.col("id").alias("passenger_id"), "country", "vipcard", "birth_date")
    return sold.join(who, "passenger_id", "left")


def _segment(sales: DataFrame, *keys: str | Column, share: bool = False) -> DataFrame:
    """Passengers, tickets, revenue and the means per passenger for each segment."""
    part = {"share": share_of_all("amount")} if share else {}
    return (
        sales.groupBy(*keys)
        .agg(
            F.count_distinct("passenger_id").alias("passengers"),
            F.sum("tickets").alias("tickets"),
            F.sum("amount").alias("amount"),
        )
        .withColumns(
            {
                "revenue": F.col("amount").cast("double"),
                "tickets_per_passenger": divide("tickets", "passengers"),
                "spend_per_passenger": divide("amount", "passengers"),
                **part,
            }
        )
        .drop("amount")
    )


def by_country(sales: DataFrame) -> DataFrame:
    return _segment(sales, "country").orderBy(F.desc("revenue"), "country")


def by_vip(sales: DataFrame) -> DataFrame:
    """Holders of a VIP card against all others, with their share of revenue."""
    return _segment(sales, "vipcard", share=True).orderBy("vipcard")


def class_by_vip(sales: DataFrame) -> DataFrame:
    """Which cabin class each segment buys."""
    return _segment(sales, "vipcard", "class").orderBy("vipcard", "class")


def age_years(born: Column, as_of: date) -> Column:
    return F.floor(F.months_between(F.lit(as_of), born) / 12)


def by_age(sales: DataFrame, as_of: date) -> DataFrame:
    """Segments by age band, named by the lower end of the band; unknown age is null."""
    age = age_years(F.col("birth_date"), as_of)
    band = F.lit(None).cast("int")
    for low in AGE_BANDS:
        band = F.when(age >= low, F.lit(low)).otherwise(band)
    return _segment(sales.withColumn("age_from", band), "age_from").orderBy("age_from")
