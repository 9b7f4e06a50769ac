"""The preparation job: raw tables in, prepared datasets out, in plain folders.

`published` does the same in versions, for jobs that run again and again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.functions.dates import DateLike, departure_window, in_years, ordered_range
from skyfacts.operators.passengers import passenger_sales
from skyfacts.operators.revenue import in_months, normalize_revenue
from skyfacts.plans import facts
from skyfacts.schemas import YEAR_FOLDER, conform
from skyfacts.sources.prepared import materialize
from skyfacts.sources.sinks import write_by_year, write_parquet
from skyfacts.sources.tables import count_rows, read_parquet

RAW_TABLES = ("airports", "routes", "airplanes", "flights", "flight_crew", "staff", "tickets", "passengers")

# Datasets at flight or assignment grain, with the column that dates them.
DATED = {
    "revenue": ("year", None),
    "q2_staff_assignments": (YEAR_FOLDER, "departure"),
    "q3_staff_usage": (YEAR_FOLDER, "departure"),
    "capacity": (YEAR_FOLDER, "departure"),
}

# Sums that the tax and the revenue fact share, so that tickets are scanned for them once.
SHARED = "monthly_tickets"

Tables = Mapping[str, DataFrame]


def read_raw(
    spark: SparkSession, root: str, extra: Mapping[str, Sequence[str]] | None = None, absent: Mapping[str, Sequence[str]] | None = None
) -> dict[str, DataFrame]:
    """All raw tables from one folder in declared types.

    `extra` names further columns to keep, by table, such as one with the seats
    of a ticket; `absent` names declared ones that the folder does not have.
    """
    extra, absent = extra or {}, absent or {}
    return {
        name: conform(read_parquet(spark, f"{root}/{name}"), name, extra.get(name, ()), absent.get(name, ()))
        for name in RAW_TABLES
    }


def datasets(
    raw: Tables, seats: str | None = None, monthly: DataFrame | None = None, unique_crew: bool = False
) -> dict[str, Callable[[], DataFrame]]:
    """How each prepared dataset is built from the raw tables.

    `monthly` are stored sums of the tickets. Crew rows known to be unique
    (quality.duplicate_keys finds none) need no grouping.
    """
    sums = facts.monthly_ticket_sums(raw["tickets"]) if monthly is None else monthly
    return {
        "tickets_agg": lambda: facts.origin_means(sums, raw["routes"]),
        "airports": lambda: raw["airports"],
        "revenue": lambda: facts.placed_revenue(
            sums.select("at", "route_code", "class", F.col("total_amount_sum").alias("revenue")), raw["routes"], raw["airports"]
        ),
        "q1_staff_counts": lambda: facts.staff_counts(raw["staff"]),
        "q2_staff_assignments": lambda: facts.staff_assignments(raw["flight_crew"], raw["routes"], raw["staff"], unique_crew),
        "q3_staff_usage": lambda: facts.staff_usage(
            raw["flights"], raw["airplanes"], raw["flight_crew"], raw["routes"]
        ),
        "capacity": lambda: facts.capacity(raw["flights"], raw["tickets"], raw["airplanes"], seats),
        "passenger_sales": lambda: passenger_sales(raw["tickets"], raw["passengers"]),
    }


def _write(name: str, df: DataFrame, path: str, refresh: Iterable[int] = ()) -> None:
    """The one way each dataset is written: dated ones by year, some years of them in a refresh."""
    if name in DATED:
        year, departure = DATED[name]
        write_by_year(df, path, year, departure, refresh=bool(refresh), years=refresh)
    else:
        write_parquet(df, path)


def prepare(raw: Tables, root: str, seats: str | None = None, unique_crew: bool = False) -> list[str]:
    """Build and write every prepared dataset; the names written."""
    spark = raw["tickets"].sparkSession
    write_parquet(facts.monthly_ticket_sums(raw["tickets"]), f"{root}/{SHARED}")
    built = datasets(raw, seats, spark.read.parquet(f"{root}/{SHARED}"), unique_crew)
    for name, build in built.items():
        _write(name, build(), f"{root}/{name}")
    return list(built)


def refresh_years(raw: Tables, root: str, first: int, last: int, seats: str | None = None, unique_crew: bool = False) -> list[str]:
    """Rebuild the folders of some years of the dated datasets, from those years' rows; the names written.

    A year without rows loses its folder. The other datasets are totals over
    all years and need a full run; `published.refresh_years` renews them too.
    """
    cut = dict(raw) | {name: raw[name].where(in_years("departure", first, last)) for name in ("flights", "flight_crew", "tickets")}
    built = datasets(cut, seats, unique_crew=unique_crew)
    for name in DATED:
        _write(name, built[name](), f"{root}/{name}", refresh=range(first, last + 1))
    return list(DATED)


def prepared_or_built(spark: SparkSession, raw: Tables, root: str, name: str, seats: str | None = None) -> DataFrame:
    """A prepared dataset, built on first use."""
    return materialize(spark, f"{root}/{name}", datasets(raw, seats)[name], lambda df, path: _write(name, df, path))


def revenue_between(
    tickets: DataFrame, routes: DataFrame, airports: DataFrame, start: DateLike = None, end: DateLike = None
) -> DataFrame:
    """Normalised revenue of the months in a range, by default the reports' own; the scan reads those departures only."""
    window = departure_window(start, end)
    return in_months(normalize_revenue(facts.revenue_fact(tickets, routes, airports, window=window)), start, end)


def read_revenue(spark: SparkSession, root: str, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """The prepared revenue, normalised; with both bounds, only their years' folders are read."""
    stored = read_parquet(spark, f"{root}/revenue")
    if start is not None and end is not None:
        low, high = ordered_range(start, end)
        stored = stored.where(F.col("year").between(low.year, high.year))
    return normalize_revenue(stored)


def report_counts(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Row count of each prepared dataset."""
    return {name: count_rows(read_parquet(spark, f"{root}/{name}")) for name in names}


def smoke_run(built: Mapping[str, Callable[[], DataFrame]], rows: int = 100) -> dict[str, DataFrame]:
    """The first rows of every preparation query, to check that each one runs."""
    return {name: build().limit(rows) for name, build in built.items()}
