"""Crew need against crew used, and staff workload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.functions.aggregates import divide, exact_mean, n_unique, sum0
from skyfacts.functions.dates import in_years
from skyfacts.functions.ranks import nearest, values_at_ranks
from skyfacts.schemas import YEAR_FOLDER

# Fixed value: days in a year, as the yearly staff figures count it.
DAYS_PER_YEAR = 365.5

# Share of employees below which hours count as high or low.
HIGH_SHARE, LOW_SHARE = 0.90, 0.10

MINUTES_PER_HOUR = 60.0


def with_period(assignments: DataFrame) -> DataFrame:
    """Departure as a timestamp, with year and month."""
    at = F.col("departure").cast("timestamp_ntz")
    return assignments.withColumns({"departure": at, "year": F.year(at), "month": F.month(at)})


def departing_in(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows that depart in the closed range of years; no bounds keep all.

    A prepared dataset also carries the year as its folder, which is pruned.
    """
    if first is None or last is None:
        return df
    kept = df.where(in_years("departure", first, last))
    return kept.where(F.col(YEAR_FOLDER).between(first, last)) if YEAR_FOLDER in df.columns else kept


def _hours(minutes: str = "flight_minutes"):
    return sum0(minutes) / F.lit(MINUTES_PER_HOUR)


def staff_kpis(counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Total staff, and mean yearly distance and hours per employee who flew.

    Total staff does not depend on any filter of the assignments. A span of
    less than a day counts as one year.
    """
    per_employee = assignments.groupBy("empno").agg(
        sum0("distance").alias("distance"),
        sum0("flight_minutes").alias("minutes"),
        F.min("departure").alias("first"),
        F.max("departure").alias("last"),
    )
    span = F.timestamp_diff("DAY", F.min("first"), F.max("last")) / F.lit(DAYS_PER_YEAR)
    means = per_employee.agg(
        exact_mean("distance").alias("km"),
        exact_mean("minutes").alias("minutes"),
        F.when(span > 0, span).otherwise(F.lit(1.0)).alias("years"),
    )
    return means.select(
        counts.agg(sum0("staff_count").alias("n")).scalar().alias("total_staff"),
        F.coalesce(F.col("km") / F.col("years"), F.lit(0.0)).alias("avg_km_per_staff"),
        F.coalesce(F.col("minutes") / F.lit(MINUTES_PER_HOUR) / F.col("years"), F.lit(0.0)).alias(
            "avg_hours_per_staff"
        ),
    )


def aircraft_crew(usage: DataFrame) -> DataFrame:
    """Mean crew required and used per aircraft model; flights without crew do not count as zero."""
    return (
        usage.groupBy("airplane_model")
        .agg(
            exact_mean("required_crew").alias("avg_required_crew"),
            exact_mean("used_crew").alias("avg_used_crew"),
        )
        .withColumn("crew_difference", F.col("avg_used_crew") - F.col("avg_required_crew"))
        .orderBy(F.desc_nulls_first("avg_required_crew"), "airplane_model")
    )


def route_crew_gap(usage: DataFrame) -> DataFrame:
    """Flights, crew required, crew used and the gap per route, largest gap first.

    Here a flight without crew adds zero. The label falls back to the route
    code when the data has no geography.
    """
    placed = {"origin", "destination"} <= set(usage.columns)
    keys = ["route_code", "origin", "destination"] if placed else ["route_code"]
    label = F.concat("origin", F.lit(" → "), "destination") if placed else F.col("route_code")
    return (
        usage.groupBy(*keys)
        .agg(
            F.count("*").alias("total_flights"),
            sum0("required_crew").alias("total_required_crew"),
            sum0("used_crew").alias("total_actual_crew"),
        )
        .withColumns(
            {
                "crew_gap": F.col("total_required_crew") - F.col("total_actual_crew"),
                "route_label": label,
            }
        )
        .orderBy(F.desc_nulls_first("crew_gap"), "route_code")
    )


def department_stats(counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Staff and flown hours per department, most staff first; null hours if none flew."""
    hours = assignments.groupBy("department").agg(_hours().alias("total_hours_required"))
    return counts.join(hours, "department", "left").orderBy(F.desc_nulls_first("staff_count"), "department")


def top_departments_by_staff(stats: DataFrame, top: int = 10) -> DataFrame:
    return stats.orderBy(F.desc_nulls_first("staff_count"), "department").limit(top)


def top_departments_by_hours(stats: DataFrame, top: int = 10) -> DataFrame:
    """Departments by hours, none counting as zero."""
    return (
        stats.withColumn("total_hours_required", F.coalesce("total_hours_required", F.lit(0.0)))
        .orderBy(F.desc("total_hours_required"), "department")
        .limit(top)
    )


def monthly_hours(assignments: DataFrame) -> DataFrame:
    """Hours, staff and hours per staff member for each month."""
    period = F.when(
        F.col("year").isNotNull() & F.col("month").isNotNull(),
        F.format_string("%d-%02d", F.col("year"), F.col("month")),
    )
    return (
        assignments.groupBy("year", "month")
        .agg(_hours().alias("total_hours"), n_unique("empno").alias("unique_staff"))
        .withColumns({"avg_hours_per_staff": divide("total_hours", "unique_staff"), "period": period})
        .orderBy("year", "month")
    )


def staff_utilisation(assignments: DataFrame) -> DataFrame:
    """Flights, hours and routes per employee, with the P90 and P10 of hours as flags.

    The thresholds are exact nearest-rank values over all employees; the passes
    that find them read the employee table through the same exchange.
    """
    base = assignments.groupBy("empno", "firstnme", "lastname", "department").agg(
        F.count("*").alias("total_flights"),
        _hours().alias("total_hours"),
        n_unique("route_code").alias("unique_routes"),
    )
    # Hours are whole minutes, so one first bucket holds few different values: no refinement.
    rules = {"p90": nearest(HIGH_SHARE), "p10": nearest(LOW_SHARE)}
    limits = values_at_ranks(base, [], "total_hours", rules, refinements=0)
    return (
        base.withColumn("_limits", limits.select(F.struct("p90", "p10")).scalar())
        .withColumns(
            {
                "is_overused": F.col("total_hours") >= F.col("_limits.p90"),
                "is_underused": F.col("total_hours") <= F.col("_limits.p10"),
                "p90_threshold": F.col("_limits.p90"),
                "p10_threshold": F.col("_limits.p10"),
            }
        )
        .drop("_limits")
        .orderBy(F.desc_nulls_first("total_hours"), "empno")
    )


_WELFARE = ("firstnme", "lastname", "department", "total_hours")


def overused(utilisation: DataFrame, names: bool = True) -> DataFrame:
    """Employees at or above the P90 of hours; names can be left out."""
    return _welfare(utilisation.where("is_overused"), names)


def underused(utilisation: DataFrame, names: bool = True) -> DataFrame:
    """Employees at or below the P10 of hours; names can be left out."""
    return _welfare(utilisation.where("is_underused"), names)


def _welfare(df: DataFrame, names: bool) -> DataFrame:
    return df.select(*(_WELFARE if names else ("empno", *_WELFARE[2:])))


def route_occupation(assignments: DataFrame) -> DataFrame:
    """Staff, assignments and crew hours per route, with averages."""
    return (
        assignments.groupBy("route_code")
        .agg(
            n_unique("empno").alias("unique_staff"),
            F.count("*").alias("assignments"),
            _hours().alias("crew_hours"),
        )
        .withColumns(
            {
                "hours_per_staff": divide("crew_hours", "unique_staff"),
                "hours_per_assignment": divide("crew_hours", "assignments"),
            }
        )
        .orderBy(F.desc("crew_hours"), "route_code")
    )


def _shortfall():
    missing = F.greatest(F.col("required_crew") - F.coalesce("used_crew", F.lit(0)), F.lit(0))
    return {
        "missing_slots": sum0(missing),
        "flights": F.count("*"),
        "short_flights": F.count_if(missing > 0),
        "required_slots": sum0("required_crew"),
    }


def _understaffing(usage: DataFrame, *keys: str) -> DataFrame:
    sums = [value.alias(name) for name, value in _shortfall().items()]
    return usage.groupBy(*keys).agg(*sums).withColumn("gap_rate", divide("short_flights", "flights"))


def understaffing_by_route(usage: DataFrame) -> DataFrame:
    """Missing crew slots and share of short-crewed flights per route, worst first."""
    return _understaffing(usage, "route_code", "origin", "destination").orderBy(
        F.desc("missing_slots"), "route_code"
    )


def understaffing_by_month(usage: DataFrame) -> DataFrame:
    """Crew shortfall over all routes for each month."""
    dated = usage.withColumn("year_month", F.trunc("departure", "month"))
    return _understaffing(dated, "year_month").orderBy("year_month")
