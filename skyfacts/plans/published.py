"""Prepared datasets as versions: full runs, refreshes of some years, and rebuilds of what is out of date.

Tickets are kept as monthly states, sums and counts that add up: per route and
class, and per passenger and class. A refresh replaces the months of the asked
years from those years' tickets, and totals over all years are merged from the
states, so no other year's tickets are read. What depends on the years directly
lies in year folders and is replaced by folder. Every run publishes all its
datasets at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from skyfacts.functions.dates import in_years
from skyfacts.operators import revenue
from skyfacts.operators.passengers import monthly_passenger_sums, sales_of_months
from skyfacts.plans import facts, prepare
from skyfacts.sources.files import fingerprints
from skyfacts.sources.sinks import with_year
from skyfacts.sources.versions import Dataset, Store, Version

#: Raw tables that a refresh reads some years of.
BY_DEPARTURE = ("flights", "flight_crew", "tickets")

#: Month folders of the ticket states: name, and how one is made from tickets.
STATES = {"monthly_tickets": facts.monthly_ticket_sums, "monthly_passengers": monthly_passenger_sums}
MONTH = "at"

#: Raw tables that each dataset is built from, and parameters of the run that it depends on.
INPUTS = {
    "monthly_tickets": ("tickets",),
    "monthly_passengers": ("tickets",),
    "tickets_agg": ("tickets", "routes"),
    "airports": ("airports",),
    "revenue": ("tickets", "routes", "airports"),
    "revenue_places": ("tickets", "routes", "airports"),
    "q1_staff_counts": ("staff",),
    "q2_staff_assignments": ("flight_crew", "routes", "staff", "unique_crew"),
    "q3_staff_usage": ("flights", "airplanes", "flight_crew", "routes"),
    "capacity": ("flights", "tickets", "airplanes", "seats"),
    "passenger_sales": ("tickets", "passengers"),
}

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Run:
    """Raw tables, and the parameters of the datasets made of them."""

    raw: Tables
    seats: str | None = None
    unique_crew: bool = False

    def inputs(self) -> dict[str, dict[str, str | None]]:
        """By dataset, the fingerprints of its inputs and the values of its parameters."""
        told = {**fingerprints(self.raw), "seats": repr(self.seats), "unique_crew": repr(self.unique_crew)}
        return {name: {key: told[key] for key in keys} for name, keys in INPUTS.items()}

    def cut(self, first: int, last: int) -> Run:
        """The same with some years of the dated tables, by bounds that reach their scans."""
        some = {name: self.raw[name].where(in_years("departure", first, last)) for name in BY_DEPARTURE}
        return Run({**self.raw, **some}, self.seats, self.unique_crew)

    def built(self, states: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Every dataset but the states, from the states and the raw tables."""
        made = prepare.datasets(self.raw, self.seats, states["monthly_tickets"], self.unique_crew)
        made["passenger_sales"] = lambda: sales_of_months(states["monthly_passengers"], self.raw["passengers"])
        made["revenue_places"] = lambda: revenue.place_months(revenue.normalize_revenue(made["revenue"]()))
        return {name: build() for name, build in made.items()}


def _partition(name: str) -> str | None:
    return MONTH if name in STATES else prepare.DATED[name][0] if name in prepare.DATED else None


def _dated(name: str, df: DataFrame) -> DataFrame:
    """The frame with the column of its year folders."""
    return with_year(df, *prepare.DATED[name]) if name in prepare.DATED else df


def _partitions(name: str, first: int, last: int) -> list[str]:
    years = range(first, last + 1)
    if name in STATES:
        return [f"{MONTH}={year:04d}-{month:02d}-01" for year in years for month in range(1, 13)]
    return [f"{prepare.DATED[name][0]}={year}" for year in years]


def _written(store: Store, run: Run, names: Iterable[str], known: Mapping[str, Dataset], inputs: Mapping) -> dict[str, Dataset]:
    """Datasets written in full: states first, then the others from them. `known` are states that are there already."""
    names, done = list(names), {}
    for name in STATES:
        if name in names:
            done[name] = store.write(name, STATES[name](run.raw["tickets"]), MONTH, inputs[name])
    rest = [name for name in names if name not in STATES]
    if rest:
        states = {name: store.open(name, {**known, **done}[name]) for name in STATES}
        made = run.built(states)
        done |= {name: store.write(name, _dated(name, made[name]), _partition(name), inputs[name]) for name in rest}
    return done


def publish(store: Store, run: Run) -> Version:
    """Build and publish every dataset."""
    since = store.current()
    return store.publish(since, _written(store, run, INPUTS, {}, run.inputs()))


def refresh_years(store: Store, run: Run, first: int, last: int) -> Version:
    """Publish all datasets with some years anew, from those years' rows.

    The outcome is that of a full run if flights, crew and tickets have changed
    in those years only; a year without rows loses its folder. A dataset whose
    other inputs or parameters have changed too, or are not known, is built in
    full, and so is one that is not there.
    """
    since, inputs = store.current(), run.inputs()
    cut, done = run.cut(first, last), {}

    def in_part(name: str) -> bool:
        changed = since.changed(name, inputs[name])
        return name in since.datasets and not set(changed) - set(BY_DEPARTURE)

    for name in STATES:
        if in_part(name):
            new = store.write(name, STATES[name](cut.raw["tickets"]), MONTH, inputs[name])
            done[name] = since.datasets[name].with_partitions(new, _partitions(name, first, last))
    done |= _written(store, run, [name for name in STATES if name not in done], {}, inputs)

    states = {name: store.open(name, done[name].only(_partitions(name, first, last))) for name in STATES}
    made = cut.built(states)
    for name in filter(in_part, prepare.DATED):
        new = store.write(name, _dated(name, made[name]), _partition(name), inputs[name])
        done[name] = since.datasets[name].with_partitions(new, _partitions(name, first, last))
    # Totals of dated tables are merged anew; what has no dated input and has not changed stays.
    rest = [name for name in INPUTS if name not in done and (set(INPUTS[name]) & set(BY_DEPARTURE) or since.changed(name, inputs[name]))]
    return store.publish(since, done | _written(store, run, rest, done, inputs))


def stale(store: Store, run: Run) -> dict[str, list[str]]:
    """The datasets that are absent or out of date, each with the inputs that changed."""
    now = store.current()
    found = {name: now.changed(name, keys) for name, keys in run.inputs().items()}
    return {name: keys for name, keys in found.items() if keys}


def up_to_date(store: Store, run: Run) -> Version:
    """The current version, after a rebuild of what is out of date; none if nothing is."""
    since, inputs = store.current(), run.inputs()
    names = [name for name in INPUTS if since.changed(name, inputs[name])]
    return store.publish(since, _written(store, run, names, since.datasets, inputs)) if names else since


def rows_written(version: Version, since: Version | None = None) -> dict[str, int]:
    """Rows of each dataset that the run behind a version wrote, counted during the writes; without those it took over."""
    before = since.datasets if since else {}
    return {name: each.rows for name, each in version.datasets.items() if before.get(name) != each}
