"""Revenue over time, by route, cabin class and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfacts.functions.aggregates import share_of_all, sum0
from skyfacts.functions.columns import normalize_names, title_case, where_equal
from skyfacts.functions.dates import DEFAULT_END, DEFAULT_START, DateLike, lenient_date, ordered_range

# Cabin class codes.
CLASS_NAMES = {"E": "Economy", "B": "Business", "P": "Premium"}

# Fixed value: a misspelt heading found in datasets written elsewhere.
MISSPELT_COUNTRY = "destination_conutry"

# The text columns of the dataset.
_TEXT = (
    "continent", "country", "city", "route", "origin", "destination",
    "destination_continent", "destination_country", "destination_city", "class",
)


def normalize_revenue(revenue: DataFrame) -> DataFrame:
    """The revenue dataset in its declared columns and types.

    Accepts either spelling of the destination country and route_code for
    route. Decimal revenue stays decimal, so that sums are exact.
    """
    df = normalize_names(revenue)
    for old, new in (("route_code", "route"), (MISSPELT_COUNTRY, "destination_country")):
        if new not in df.columns:
            df = df.withColumnRenamed(old, new)
    exact = isinstance(df.schema["revenue"].dataType, T.DecimalType)
    return df.select(
        F.col("year").cast("bigint").alias("year"),
        lenient_date(df, "month").alias("year_month"),
        *[F.col(name).cast("string").alias(name) for name in _TEXT],
        (F.col("revenue") if exact else F.col("revenue").cast("double")).alias("revenue"),
    )


def in_months(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    """Months whose first day lies in the closed range; swapped bounds are put in order."""
    low, high = ordered_range(start, end)
    return df.where(F.col("year_month").between(F.lit(low), F.lit(high)))


def at_place(
    df: DataFrame, continent: str | None = None, country: str | None = None, city: str | None = None, **more: str | None
) -> DataFrame:
    """Revenue from one origin continent, country and city; All leaves a level open.

    The other columns of either end of the route, the route and the class can be chosen by name.
    """
    chosen = {"continent": continent, "country": country, "city": city, **more}
    unknown = set(more) - set(_TEXT)
    if unknown:
        raise ValueError(f"no such column of the revenue dataset: {', '.join(sorted(unknown))}")
    for name, value in chosen.items():
        df = where_equal(df, name, value)
    return df


#: Levels of a place, from the widest.
LEVELS = ("continent", "country", "city")


def place_months(df: DataFrame) -> DataFrame:
    """Each origin continent, country and city with the months that have its revenue: a small closed dictionary.

    at_place, in_months, month_bounds and columns.option_values work on it as on
    the dataset, so options and date bounds of any choice need no look at that.
    """
    return df.select(*LEVELS, "year_month").distinct()


def _total(group: DataFrame, *keys: str) -> DataFrame:
    return group.groupBy(*keys).agg(sum0("revenue").cast("double").alias("total_revenue"))


def total_revenue(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    """Revenue in the range, 0 when there is none."""
    return _total(in_months(df, start, end))


def top_route(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    """The route with the highest revenue."""
    keys = ("route", "city", "country", "destination_city", "destination_country")
    return _total(in_months(df, start, end), *keys).orderBy(F.desc("total_revenue"), *keys).limit(1)


def top_city(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    """The origin city with the highest revenue."""
    keys = ("continent", "country", "city")
    return _total(in_months(df, start, end), *keys).orderBy(F.desc("total_revenue"), *keys).limit(1)


def monthly_revenue(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    return _total(in_months(df, start, end), "year_month").orderBy("year_month")


def revenue_by_class(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    return _total(in_months(df, start, end), "class").orderBy(F.desc("total_revenue"), "class")


def revenue_by_country(df: DataFrame, start: DateLike = DEFAULT_START, end: DateLike = DEFAULT_END) -> DataFrame:
    """Revenue per origin country."""
    return _total(in_months(df, start, end), "country").orderBy(F.desc("total_revenue"), "country")


def with_share(totals: DataFrame) -> DataFrame:
    """Totals per group with each one's share of all revenue."""
    return totals.withColumn("share", share_of_all("total_revenue"))


def with_class_name(df: DataFrame) -> DataFrame:
    """Adds the class name; null for an unknown code."""
    pairs = [F.lit(item) for pair in CLASS_NAMES.items() for item in pair]
    return df.withColumn("class_name", F.element_at(F.create_map(*pairs), F.col("class")))


def leader(totals: DataFrame, name: str) -> DataFrame:
    """The row with the highest revenue; the smaller key wins a tie."""
    return totals.orderBy(F.desc("total_revenue"), name).limit(1)


def leading_class(by_class: DataFrame) -> DataFrame:
    return with_class_name(leader(by_class, "class"))


def leading_country(by_country: DataFrame) -> DataFrame:
    return leader(by_country, "country").withColumn("country_label", title_case(F.col("country")))


def month_bounds(df: DataFrame) -> DataFrame:
    """First and last month with revenue."""
    return df.agg(F.min("year_month").alias("start_date"), F.max("year_month").alias("end_date"))
