"""Every registered query: how Spark builds it, and the SQL that must agree.

Means of doubles depend on the order of addition in their last bits, so they
are rounded on both sides; sums of decimals and integers are exact and are not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.functions import bitmaps
from skyfacts.functions import columns as cols
from skyfacts.functions.dates import DateLike, add_date_parts
from skyfacts.operators import capacity, network, passengers, profiling, quality, revenue, screening, staff, tax
from skyfacts.plans import facts
from skyfacts.plans.airline_views import AirlineViews
from skyfacts.plans.oracle_views import with_views
from skyfacts.plans.prepare import revenue_between
from skyfacts.sources import prepared, tables

Build = Callable[[AirlineViews], DataFrame]


@dataclass(frozen=True)
class Query:
    """A query, the inventory entries it covers, and its oracle text."""

    covers: str
    build: Build
    sql: str


QUERIES: dict[str, Query] = {}


def register(name: str, covers: str, views: str, sql: str) -> Callable[[Build], Build]:
    """Adds a query; views names the oracle views its SQL reads."""

    def add(build: Build) -> Build:
        QUERIES[name] = Query(covers, build, with_views(sql, *views.split()))
        return build

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


# Query parameters.
START, END = "1996-03-15", "1999-06-20"
FIRST_YEAR, LAST_YEAR = 1997, 1999
CONTINENTS, COUNTRIES = ["ASIA", "EUROPE"], ["NATION_2", "NATION_3", "NATION_7", "NATION_13", "NATION_22"]
TAX_RANGE = (8.2, 8.6)
PLACE = {"continent": "ASIA", "country": "NATION_7"}
AS_OF = date(2025, 1, 1)
# Destinations with a column of their own; the rest share one.
LISTED = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]

# The months that the range START..END keeps.
IN_RANGE = "year_month between date '1996-03-15' and date '1999-06-20'"
IN_YEARS = "year(departure) between 1997 and 1999"

# --- tax burden ---------------------------------------------------------------


def _tax_report(v: AirlineViews) -> DataFrame:
    return tax.airport_tax(facts.tickets_by_origin(v.tickets, v.routes), v.airports)


def _tax_filtered(v: AirlineViews) -> DataFrame:
    return tax.filter_tax(_tax_report(v), CONTINENTS, COUNTRIES, TAX_RANGE)


@register("tickets_by_origin", "A-01 J-01 P-06", "tickets_agg", "select * from tickets_agg")
def _(v):
    return facts.tickets_by_origin(v.tickets, v.routes)


@register("airport_tax_report", "J-10 P-05 P-06 P-07 P-08 T-01", "tax_report", "select * from tax_report")
def _(v):
    return tax.airport_tax_report(facts.tickets_by_origin(v.tickets, v.routes), v.airports)


register(
    "tax_filtered", "F-01 F-02 X-13", "tax_report",
    """select * from tax_report where origin_continent in ('ASIA', 'EUROPE')
       and origin_country in ('NATION_2', 'NATION_3', 'NATION_7', 'NATION_13', 'NATION_22')
       and avg_tax_pct between 8.2 and 8.6""",
)(_tax_filtered)


@register(
    "tax_unfiltered", "F-02", "tax_report",
    """select origin, origin_continent, origin_country, avg_tax_pct from tax_report
       where origin_continent is not null and origin_country is not null and avg_tax_pct is not null""",
)
def _(v):
    return tax.filter_tax(_tax_report(v)).select("origin", "origin_continent", "origin_country", "avg_tax_pct")


_TAX_KPIS = """
    select cast(coalesce(sum(ticket_count), 0) as bigint) as total_tickets, round(avg(avg_total_tax), 6) as avg_total_tax,
           round(avg(avg_tax_pct), 9) as avg_tax_pct, count(*) as airports,
           round(sum(avg_total_tax * ticket_count) / sum(avg_ticket_value * ticket_count), 9) as weighted_tax_share
    from tax_report where {0}"""


@register("tax_kpis", "A-08", "tax_report", _TAX_KPIS.format("origin_country is not null and avg_tax_pct is not null"))
def _(v):
    kpis = tax.tax_kpis(tax.filter_tax(_tax_report(v)))
    return rounded(rounded(kpis, 9, "avg_tax_pct", "weighted_tax_share"), 6, "avg_total_tax")


@register("tax_map_points", "F-07", "tax_report", "select * from tax_report where lat is not null and lon is not null")
def _(v):
    return tax.located(_tax_report(v))


@register(
    "top_airports_tax_collected", "T-02 P-09", "tax_report",
    """select *, avg_total_tax * ticket_count as total_tax_collected from tax_report
       order by total_tax_collected desc nulls first, origin limit 15""",
)
def _(v):
    return tax.top_airports_by_tax(_tax_report(v))


@register(
    "top_countries_tax", "A-20 T-03", "tax_report",
    """select origin_country, origin_continent, round(avg(avg_tax_pct), 9) as avg_tax_pct,
              cast(coalesce(sum(ticket_count), 0) as bigint) as ticket_count,
              round(avg(avg_ticket_value), 6) as avg_ticket_value
       from tax_report group by all order by avg(tax_report.avg_tax_pct) desc nulls first, 1, 2 limit 15""",
)
def _(v):
    return rounded(rounded(tax.top_countries_by_tax(_tax_report(v)), 9, "avg_tax_pct"), 6, "avg_ticket_value")


@register(
    "airport_tax_table", "P-10", "tax_report",
    """select origin as "IATA", origin_airport as "Airport", origin_city as "City", origin_country as "Country",
              origin_continent as "Continent", ticket_count as "Tickets", avg_airport_tax as "Avg Airport Tax ($)",
              avg_local_tax as "Avg Local Tax ($)", avg_total_tax as "Avg Total Tax ($)",
              avg_tax_pct as "Tax % of Ticket", avg_ticket_value as "Avg Ticket Value ($)"
       from tax_report""",
)
def _(v):
    return tax.airport_tax_table(_tax_report(v))


@register("tax_bound", "A-29 X-18", "tax_report", "select round(max(avg_tax_pct), 1) as max_tax_pct from tax_report")
def _(v):
    return tax.tax_bound(_tax_report(v))


@register(
    "tax_country_options", "A-28", "tax_report",
    """select distinct origin_country from tax_report
       where origin_country is not null and origin_continent in ('ASIA', 'EUROPE')""",
)
def _(v):
    return tax.country_options(_tax_report(v), CONTINENTS)


# --- revenue ------------------------------------------------------------------


def _revenue(v: AirlineViews) -> DataFrame:
    """All months."""
    return revenue.normalize_revenue(facts.revenue_fact(v.tickets, v.routes, v.airports))


def _revenue_in_range(v: AirlineViews, start: DateLike = START, end: DateLike = END) -> DataFrame:
    """The months of the report range, cut at the scan."""
    return revenue_between(v.tickets, v.routes, v.airports, start, end)


_REVENUE_KEYS = """year, year_month, continent, country, city, route, origin, destination, destination_continent,
    destination_country, destination_city, class"""


@register(
    "revenue_by_departure", "A-02 J-02 J-03 J-04 P-24 X-10", "revenue_rows",
    """select cast(year(departure) as bigint) as year, cast(date_trunc('month', departure) as date) as month,
              continent, country, city, route_code, origin, destination, destination_continent, destination_country,
              destination_city, class, cast(sum(total_amount) as double) as revenue
       from revenue_rows group by departure, continent, country, city, route_code, origin, destination,
              destination_continent, destination_country, destination_city, class""",
)
def _(v):
    return as_double(facts.revenue_fact(v.tickets, v.routes, v.airports, grain="departure"), "revenue")


@register(
    "revenue_fact", "A-02 P-03 P-04 X-09", "revenue",
    f"select {_REVENUE_KEYS}, cast(sum(revenue) as double) as revenue from revenue group by {_REVENUE_KEYS}",
)
def _(v):
    return as_double(_revenue(v), "revenue")


@register(
    "revenue_total", "A-14 F-04 X-11 X-17", "revenue",
    f"select coalesce(cast(sum(revenue) as double), 0) as total_revenue from revenue where {IN_RANGE}",
)
def _(v):
    return revenue.total_revenue(_revenue_in_range(v), START, END)


@register(
    "revenue_total_default_range", "A-14 F-04 F-14", "revenue",
    """select coalesce(cast(sum(revenue) as double), 0) as total_revenue from revenue
       where year_month between date '2020-01-01' and date '2025-12-31'""",
)
def _(v):
    return revenue.total_revenue(_revenue_in_range(v, None, None))


@register(
    "revenue_top_route", "A-15 T-07 T-11", "revenue",
    f"""select route, city, country, destination_city, destination_country, cast(sum(revenue) as double) as total_revenue
        from revenue where {IN_RANGE} group by all
        order by total_revenue desc, route, city, country, destination_city, destination_country limit 1""",
)
def _(v):
    return cols.first_row(revenue.top_route(_revenue_in_range(v), START, END))


@register(
    "revenue_top_city", "A-16 T-07", "revenue",
    f"""select continent, country, city, cast(sum(revenue) as double) as total_revenue
        from revenue where {IN_RANGE} group by all order by total_revenue desc, continent, country, city limit 1""",
)
def _(v):
    return revenue.top_city(_revenue_in_range(v), START, END)


@register(
    "revenue_trend", "A-17", "revenue",
    f"select year_month, cast(sum(revenue) as double) as total_revenue from revenue where {IN_RANGE} group by year_month",
)
def _(v):
    return revenue.monthly_revenue(_revenue_in_range(v), START, END)


_BY_CLASS = f"select class, cast(sum(revenue) as double) as total_revenue from revenue where {IN_RANGE} group by class"


@register(
    "revenue_by_class", "A-18 W-01", "revenue",
    f"""select class, total_revenue, round(total_revenue / sum(total_revenue) over (), 9) as share
        from ({_BY_CLASS})""",
)
def _(v):
    return rounded(revenue.with_share(revenue.revenue_by_class(_revenue_in_range(v), START, END)), 9, "share")


@register(
    "revenue_by_country", "A-19", "revenue",
    f"select country, cast(sum(revenue) as double) as total_revenue from revenue where {IN_RANGE} group by country",
)
def _(v):
    return revenue.revenue_by_country(_revenue_in_range(v), START, END)


@register(
    "revenue_top_class", "F-09 W-03 X-05", "revenue",
    f"""select class, total_revenue,
               case class when 'E' then 'Economy' when 'B' then 'Business' when 'P' then 'Premium' end as class_name
        from ({_BY_CLASS}) order by total_revenue desc, class limit 1""",
)
def _(v):
    return revenue.leading_class(revenue.revenue_by_class(_revenue_in_range(v), START, END))


@register(
    "revenue_top_country", "F-09 X-04", "revenue",
    f"""select country, cast(sum(revenue) as double) as total_revenue,
               upper(country[1]) || lower(country[2:]) as country_label
        from revenue where {IN_RANGE} group by country order by total_revenue desc, country limit 1""",
)
def _(v):
    return revenue.leading_country(revenue.revenue_by_country(_revenue_in_range(v), START, END))


@register(
    "revenue_date_bounds", "A-27", "revenue",
    "select min(year_month) as start_date, max(year_month) as end_date from revenue where continent = 'ASIA' and country = 'NATION_7'",
)
def _(v):
    return revenue.month_bounds(revenue.at_place(_revenue(v), **PLACE))


@register(
    "revenue_by_location", "F-03 F-04 A-17", "revenue",
    f"""select year_month, cast(sum(revenue) as double) as total_revenue from revenue
        where {IN_RANGE} and continent = 'ASIA' and country = 'NATION_7' group by year_month""",
)
def _(v):
    return revenue.monthly_revenue(revenue.at_place(_revenue_in_range(v), city="All", **PLACE), START, END)


@register(
    "revenue_city_options", "A-28 F-03", "revenue",
    "select distinct city from revenue where city is not null and continent = 'ASIA' and country = 'NATION_7'",
)
def _(v):
    return cols.option_values(revenue.at_place(_revenue(v), **PLACE), "city")


@register("revenue_place_months", "F-03 A-27 A-28", "revenue", "select distinct continent, country, city, year_month from revenue")
def _(v):
    return revenue.place_months(_revenue(v))


# --- crew and staff -------------------------------------------------------------


def _assignments(v: AirlineViews) -> DataFrame:
    """The crew view is distinct, so its rows need no second grouping."""
    return staff.with_period(facts.staff_assignments(v.flight_crew, v.routes, v.staff, unique_crew=True))


def _usage(v: AirlineViews) -> DataFrame:
    return facts.staff_usage(v.flights, v.airplanes, v.flight_crew, v.routes)


@register("staff_counts", "A-03", "staff_counts", "select * from staff_counts")
def _(v):
    return facts.staff_counts(v.staff)


@register("staff_assignments", "A-04 J-05 J-06", "assignments", "select * from assignments")
def _(v):
    return facts.staff_assignments(v.flight_crew, v.routes, v.staff)


@register(
    "staff_assignments_dated", "P-11 X-07 F-05", "assignments",
    f"""select empno, flight_id, route_code, departure, cast(year(departure) as integer) as year,
               cast(month(departure) as integer) as month
        from assignments where {IN_YEARS}""",
)
def _(v):
    dated = staff.departing_in(_assignments(v), FIRST_YEAR, LAST_YEAR)
    return dated.select("empno", "flight_id", "route_code", "departure", "year", "month")


@register("crew_used", "A-05", "crew_used", "select * from crew_used")
def _(v):
    return facts.crew_used(v.flight_crew)


@register("staff_usage", "A-06 J-07 J-08 J-09 P-12", "usage", "select * from usage")
def _(v):
    return _usage(v)


_STAFF_KPIS = """
    select (select cast(sum(staff_count) as bigint) from staff_counts) as total_staff,
           coalesce(km / years, 0) as avg_km_per_staff, coalesce(minutes / 60.0::double / years, 0) as avg_hours_per_staff
    from (select cast(sum(km) as double) / count(*) as km, cast(sum(minutes) as double) / count(*) as minutes,
                 case when datesub('day', min(a), max(b)) / 365.5::double > 0
                      then datesub('day', min(a), max(b)) / 365.5::double else 1.0::double end as years
          from (select coalesce(sum(distance), 0) as km, coalesce(sum(flight_minutes), 0) as minutes,
                       min(departure) as a, max(departure) as b
                from assignments where {0} group by empno))"""


@register("staff_kpis", "A-07 X-12", "staff_counts assignments", _STAFF_KPIS.format("true"))
def _(v):
    return staff.staff_kpis(facts.staff_counts(v.staff), _assignments(v))


@register("staff_kpis_in_years", "A-07 F-05", "staff_counts assignments", _STAFF_KPIS.format(IN_YEARS))
def _(v):
    return staff.staff_kpis(
        facts.staff_counts(v.staff), staff.departing_in(_assignments(v), FIRST_YEAR, LAST_YEAR)
    )


@register(
    "aircraft_crew", "A-09 P-13", "usage",
    """select airplane_model, cast(sum(required_crew) as double) / count(required_crew) as avg_required_crew,
              cast(sum(used_crew) as double) / count(used_crew) as avg_used_crew,
              cast(sum(used_crew) as double) / count(used_crew)
                  - cast(sum(required_crew) as double) / count(required_crew) as crew_difference
       from usage group by airplane_model""",
)
def _(v):
    return staff.aircraft_crew(_usage(v))


_ROUTE_GAP = """
    select *, total_required_crew - total_actual_crew as crew_gap, origin || ' → ' || destination as route_label
    from (select route_code, origin, destination, count(*) as total_flights,
                 cast(coalesce(sum(required_crew), 0) as bigint) as total_required_crew,
                 cast(coalesce(sum(used_crew), 0) as bigint) as total_actual_crew
          from usage where {0} group by route_code, origin, destination)"""


@register("route_crew_gap", "A-10 P-14 P-15 X-01", "usage", _ROUTE_GAP.format("true"))
def _(v):
    return staff.route_crew_gap(_usage(v))


@register("route_crew_gap_in_years", "A-10 F-06", "usage", _ROUTE_GAP.format(IN_YEARS))
def _(v):
    return staff.route_crew_gap(staff.departing_in(_usage(v), FIRST_YEAR, LAST_YEAR))


_DEPARTMENTS = """
    select c.department, c.staff_count, h.hours as total_hours_required
    from staff_counts c left join (select department, coalesce(sum(flight_minutes), 0) / 60.0::double as hours
                                   from assignments group by department) h on h.department = c.department"""


def _departments(v: AirlineViews) -> DataFrame:
    return staff.department_stats(facts.staff_counts(v.staff), _assignments(v))


register("department_stats", "A-11 J-11", "staff_counts assignments", _DEPARTMENTS)(_departments)


@register(
    "departments_by_staff", "T-04", "staff_counts assignments",
    _DEPARTMENTS + " order by c.staff_count desc nulls first, c.department limit 10",
)
def _(v):
    return staff.top_departments_by_staff(_departments(v))


@register(
    "departments_by_hours", "T-04 X-11", "staff_counts assignments",
    f"""select department, staff_count, coalesce(total_hours_required, 0) as total_hours_required
        from ({_DEPARTMENTS}) order by total_hours_required desc, department limit 10""",
)
def _(v):
    return staff.top_departments_by_hours(_departments(v))


@register(
    "flying_hours_monthly", "A-12 P-16 P-17 T-08 X-02", "assignments",
    """select *, total_hours / unique_staff as avg_hours_per_staff, printf('%d-%02d', year, month) as period
       from (select cast(year(departure) as integer) as year, cast(month(departure) as integer) as month,
                    coalesce(sum(flight_minutes), 0) / 60.0::double as total_hours,
                    count(distinct empno) as unique_staff
             from assignments group by 1, 2)""",
)
def _(v):
    return staff.monthly_hours(_assignments(v))


def _utilisation(v: AirlineViews) -> DataFrame:
    return staff.staff_utilisation(_assignments(v))


register("staff_utilisation", "A-13 W-02 X-15", "utilisation", "select * from utilisation")(_utilisation)


@register(
    "staff_overused", "F-08 P-23", "utilisation",
    "select firstnme, lastname, department, total_hours from utilisation where is_overused",
)
def _(v):
    return staff.overused(_utilisation(v))


@register(
    "staff_underused", "F-08 P-23 D-14", "utilisation",
    "select empno, department, total_hours from utilisation where is_underused",
)
def _(v):
    return staff.underused(_utilisation(v), names=False)


_MASTER_VIEWS = "flight_crew flights routes airplanes staff"
_MASTER = """
    select c.*, f.airplane, cast(f.price_economy as double) as price_economy, f.flight_leg, r.* exclude (route_code),
           p.* exclude (aircraft_registration), s.firstnme, s.lastname, s.gender, s.hiredate, s.department
    from flight_crew c
         left join flights f on (f.flight_id, f.route_code, f.departure) = (c.flight_id, c.route_code, c.departure)
         left join routes r on r.route_code = f.route_code
         left join airplanes p on p.aircraft_registration = f.airplane
         left join staff s on s.empno = c.empno"""


def _master(v: AirlineViews) -> DataFrame:
    return facts.crew_master(v.flight_crew, v.flights, v.routes, v.airplanes, v.staff)


@register("crew_master", "J-12 J-13", _MASTER_VIEWS, _MASTER)
def _(v):
    return as_double(_master(v), "price_economy")


@register(
    "crew_master_quality", "A-36 A-38", _MASTER_VIEWS,
    f"""select count(*) as n_rows, 30 as n_columns, count(*) filter (crew_members is null) as null_crew_members,
               count(*) filter (flight_minutes is null) as null_flight_minutes,
               count(*) filter (department is null) as null_department from ({_MASTER})""",
)
def _(v):
    return profiling.join_quality(_master(v), ["crew_members", "flight_minutes", "department"])


@register(
    "route_occupation", "D-01", "assignments",
    """select *, crew_hours / unique_staff as hours_per_staff, crew_hours / assignments as hours_per_assignment
       from (select route_code, count(distinct empno) as unique_staff, count(*) as assignments,
                    coalesce(sum(flight_minutes), 0) / 60.0::double as crew_hours
             from assignments group by route_code)""",
)
def _(v):
    return staff.route_occupation(_assignments(v))


_SHORTFALL = """
    select {0}, cast(coalesce(sum(missing), 0) as bigint) as missing_slots, count(*) as flights,
           count(*) filter (missing > 0) as short_flights,
           cast(coalesce(sum(required_crew), 0) as bigint) as required_slots,
           count(*) filter (missing > 0) / count(*) as gap_rate
    from (select *, cast(date_trunc('month', departure) as date) as year_month,
                 greatest(required_crew - coalesce(used_crew, 0), 0) as missing from usage)
    group by {0}"""


@register("understaffing_by_route", "D-02", "usage", _SHORTFALL.format("route_code, origin, destination"))
def _(v):
    return staff.understaffing_by_route(_usage(v))


@register("understaffing_by_month", "D-03", "usage", _SHORTFALL.format("year_month"))
def _(v):
    return staff.understaffing_by_month(_usage(v))


# --- seat occupancy ---------------------------------------------------------------


def _capacity(v: AirlineViews) -> DataFrame:
    return facts.capacity(v.flights, v.tickets, v.airplanes, seats="seats")


def _occupancy(v: AirlineViews) -> DataFrame:
    return capacity.occupancy(_capacity(v))


register("capacity_fact", "D-08", "capacity", "select * from capacity")(_capacity)
register("capacity_occupancy", "P-18 P-19 X-07 X-08", "occupancy", "select * from occupancy")(_occupancy)


@register(
    "capacity_kpis", "A-26", "occupancy",
    """select round(avg(capacity_pct), 9) as avg_capacity, max(capacity_pct) as max_capacity,
              count(distinct flight_id) as flights, count(distinct route_id) as routes from occupancy""",
)
def _(v):
    return rounded(capacity.occupancy_kpis(_occupancy(v)), 9, "avg_capacity")


_OVER = """select {0}, round(avg(capacity_pct), 9) as avg_capacity, count(distinct flight_id) as flights
           from occupancy group by {0}"""


@register("capacity_by_week", "A-21", "occupancy", _OVER.format("week"))
def _(v):
    return rounded(capacity.by_week(_occupancy(v)), 9, "avg_capacity")


@register("capacity_by_month", "A-22", "occupancy", _OVER.format("year_month"))
def _(v):
    return rounded(capacity.by_month(_occupancy(v)), 9, "avg_capacity")


@register(
    "capacity_by_weekday", "A-23 X-06 U-01", "occupancy",
    f"select *, dayname(date '2024-01-01' + (day_of_week - 1)) as day_name from ({_OVER.format('day_of_week')})",
)
def _(v):
    return rounded(capacity.by_weekday(_occupancy(v)), 9, "avg_capacity")


_PERIODS = {"week": "cast(week as varchar)", "month": "year_month", "weekday": "cast(day_of_week as varchar)", "all": "null::varchar"}


@register(
    "capacity_by_periods", "A-12 A-21 A-22 A-23 A-26", "occupancy",
    " union all ".join(
        f"""select '{kind}' as kind, {period} as period, round(avg(capacity_pct), 9) as avg_capacity,
                   count(distinct flight_id) as flights from occupancy group by all"""
        for kind, period in _PERIODS.items()
    ),
)
def _(v):
    numbers = bitmaps.dictionary(v.flights, "flight_id", parts=bitmaps.parts_for(v.input_bytes))
    states = capacity.daily_states(_occupancy(v), numbers)
    return rounded(capacity.by_periods(states), 9, "avg_capacity")


_BY_FLIGHT = """select flight_id, avg(capacity_pct) as avg_capacity, max(capacity_pct) as max_capacity,
                       min(capacity_pct) as min_capacity, min(route_id) as route_id, count(departure) as observations
                from occupancy group by flight_id"""


@register(
    "capacity_by_flight", "A-24", "occupancy",
    f"select * replace (round(avg_capacity, 9) as avg_capacity) from ({_BY_FLIGHT})",
)
def _(v):
    return rounded(capacity.by_flight(_occupancy(v)), 9, "avg_capacity")


@register(
    "capacity_top_flights", "T-05 U-02 X-14", "occupancy",
    f"""select flight_id, printf('%.1f%%', avg_capacity * 100) as avg_capacity, route_id from ({_BY_FLIGHT}) f
        where f.avg_capacity is not null order by f.avg_capacity desc, flight_id limit 10""",
)
def _(v):
    return capacity.top_flights(capacity.by_flight(_occupancy(v)))


_BY_ROUTE = """select route_id, round(avg(capacity_pct), 9) as avg_capacity, max(capacity_pct) as max_capacity,
                      count(distinct flight_id) as num_flights, count(departure) as observations
               from occupancy group by route_id"""


@register("capacity_by_route", "A-25", "occupancy", _BY_ROUTE)
def _(v):
    return rounded(capacity.by_route(_occupancy(v)), 9, "avg_capacity")


@register(
    "capacity_top_routes", "T-06", "occupancy",
    _BY_ROUTE + " order by avg(capacity_pct) desc nulls first, route_id limit 20",
)
def _(v):
    return rounded(capacity.top_routes(capacity.by_route(_occupancy(v))), 9, "avg_capacity")


@register(
    "capacity_thresholds", "F-10", "occupancy",
    f"""select count(*) filter (avg_capacity > 0.9) as flights_over_90,
               count(*) filter (avg_capacity < 0.5) as flights_under_50,
               (select count(distinct route_id) from occupancy) as routes from ({_BY_FLIGHT})""",
)
def _(v):
    return capacity.occupancy_thresholds(_occupancy(v))


# --- generic summaries and profiles --------------------------------------------------

_TICKET_TYPES = {
    "ticket_id": "bigint", "passenger_id": "bigint", "flight_id": "string", "route_code": "string",
    "departure": "timestamp_ntz", "class": "string", "plane_number": "bigint", "leg": "smallint", "seats": "int",
    "price": "decimal(12,2)", "airport_tax": "decimal(17,4)", "local_tax": "decimal(17,4)", "total_amount": "decimal(17,4)",
}


def _profile_sql(table: str, types: dict[str, str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", '{t}' as dtype, count(*) - count({c}) as nulls,
                   count(distinct {c}) + cast(bool_or({c} is null) as integer) as n_unique,
                   (count(*) - count({c})) / greatest(count(*), 1) as null_rate from {table}"""
        for c, t in types.items()
    )


@register("profile_tickets", "A-33", "tickets", _profile_sql("tickets", _TICKET_TYPES))
def _(v):
    return profiling.profile(v.passenger_tickets)


_ROUTE_TYPES = {
    "route_code": "string", "origin": "string", "destination": "string", "parent_route": "string",
    "leg_number": "smallint", "distance": "int", "flight_minutes": "smallint",
}


@register("profile_routes", "A-33", "routes", _profile_sql("routes", _ROUTE_TYPES))
def _(v):
    return profiling.profile(v.routes)


def _describe_sql(table: str, types: dict[str, str]) -> str:
    def rank(c: str, q: float) -> str:
        return f"""(select max({c}) from (select cast({c} as double) as {c}, row_number() over (order by {c}) as rn,
                    count(*) over () as n from {table} where {c} is not null) where rn - 1 = floor({q} * (n - 1) + 0.5))"""

    def numeric(c: str) -> str:
        return f"""round(avg(cast({c} as double)), 4) as mean, round(stddev(cast({c} as double)), 4) as std,
                   cast(min({c}) as double) as min, {rank(c, 0.25)} as p25, {rank(c, 0.5)} as p50, {rank(c, 0.75)} as p75,
                   cast(max({c}) as double) as max, null::varchar as "first", null::varchar as "last\""""

    def other(c: str) -> str:
        none = ", ".join(f"null::double as {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        return f"""{none}, min({c})::varchar as "first", max({c})::varchar as "last\""""

    return " union all ".join(
        f"""select '{c}' as "column", count({c}) as "count", count(*) - count({c}) as null_count,
                   {other(c) if t in ("string", "timestamp_ntz") else numeric(c)} from {table}"""
        for c, t in types.items()
    )


@register("describe_tickets", "A-34 P-21", "tickets", _describe_sql("tickets", _TICKET_TYPES))
def _(v):
    return rounded(profiling.describe(v.passenger_tickets), 4, "mean", "std")


@register(
    "describe_routes", "A-34", "routes", _describe_sql("routes", _ROUTE_TYPES),
)
def _(v):
    return rounded(profiling.describe(v.routes), 4, "mean", "std")


@register(
    "top_categories", "A-30 T-10", "tickets",
    "select route_code, count(*) as n_rows from tickets group by route_code order by n_rows desc, route_code limit 10",
)
def _(v):
    return profiling.top_categories(v.tickets, "route_code")


def _summary_sql(category: str, value: str) -> str:
    number = f"cast({value} as double)"
    return f"""select {category}, count(*) as n_rows, cast(sum({value}) as double) / count({value}) as avg_{value},
                      round(median({number}), 6) as median_{value}, min({number}) as min_{value},
                      max({number}) as max_{value}
               from tickets group by {category} order by avg_{value} desc nulls first, {category} limit 10"""


@register("numeric_summary", "A-31", "tickets", _summary_sql("class", "total_amount"))
def _(v):
    found = profiling.numeric_summary(v.tickets, "class", "total_amount")
    return rounded(as_double(found, "min_total_amount", "max_total_amount"), 6, "median_total_amount")


@register("numeric_summary_routes", "A-31", "tickets", _summary_sql("route_code", "price"))
def _(v):
    found = profiling.numeric_summary(v.tickets, "route_code", "price")
    return rounded(as_double(found, "min_price", "max_price"), 6, "median_price")


@register(
    "monthly_counts", "A-32", "tickets",
    """select cast(year(departure) as integer) as year, cast(month(departure) as integer) as month, count(*) as n_rows
       from tickets group by 1, 2""",
)
def _(v):
    return profiling.monthly_counts(v.tickets, "departure")


@register(
    "date_parts", "P-20 X-16", "staff",
    """select empno, hiredate, cast(year(hiredate) as integer) as year, cast(month(hiredate) as integer) as month,
              cast(isodow(hiredate) as integer) as weekday
       from (select empno, case when empno % 7 not in (0, 3, 5) then hiredate end as hiredate from staff)""",
)
def _(v):
    """Hire dates as a text file has them: blanks around, words, months only, days that do not exist."""
    day, kind = F.col("hiredate").cast("string"), F.col("empno") % 7
    text = F.when(kind == 0, "unknown").when(kind == 3, F.substring(day, 1, 7)).when(kind == 5, F.concat(F.substring(day, 1, 5), F.lit("02-30")))
    return add_date_parts(v.staff.select("empno", text.otherwise(F.concat(F.lit(" "), day, F.lit(" "))).alias("hiredate")), "hiredate")


@register(
    "revenue_from_text", "P-03 P-04 X-09", "revenue",
    f"""select * replace (case when year % 3 <> 0 then year_month end as year_month)
        from (select {_REVENUE_KEYS}, cast(sum(revenue) as double) as revenue from revenue group by {_REVENUE_KEYS})""",
)
def _(v):
    """The dataset as others write it: a misspelt heading, padded names, months as text that is not always a day."""
    fact = facts.revenue_fact(v.tickets, v.routes, v.airports)
    month = F.when(F.col("year") % 3 != 0, F.col("month").cast("string")).otherwise(F.lit("n/a"))
    written = fact.withColumn("month", month).withColumnRenamed("destination_country", " Destination_Conutry ")
    return as_double(revenue.normalize_revenue(written), "revenue")


@register(
    "market_segment_labels", "X-04 X-14", "staff",
    """select label, n as n_staff, case when n > 0 then format('{:,}', n) end as n_staff_text from (
           select case department when 'GROUND' then 'Ground-Staff O''Neil' else department[1] || lower(department[2:]) || ' Division 1St' end as label,
                  count(*) as n from staff group by 1)""",
)
def _(v):
    """Labels of several words, and counts with thousands separators."""
    full = F.when(F.col("department") == "GROUND", "ground-staff o'neil").otherwise(F.concat("department", F.lit(" DIVISION 1ST")))
    counts = v.staff.groupBy(cols.title_case(full).alias("label")).agg(F.count("*").alias("n_staff"))
    return counts.withColumn("n_staff_text", cols.amount_text(F.col("n_staff")))


@register(
    "extract_airplanes", "S-17", "airplanes",
    "select aircraft_registration, model, crew_members, seats_economy, seats_premium, seats_business from airplanes",
)
def _(v):
    return prepared.extracted({"airplanes": v.airplanes}, "airplanes")


@register("export_staff", "S-20", "staff", "select * from staff")
def _(v):
    padded = v.staff.toDF(*[f" {name.upper()} " for name in v.staff.columns])
    return prepared.clean(padded)


@register("option_values", "A-28", "airports", "select distinct country from airports where country is not null")
def _(v):
    return cols.option_values(v.airports, "country")


@register("table_shape", "A-38 S-06", "tickets", "select count(*) as n_rows, 13 as n_columns from tickets")
def _(v):
    return profiling.shape(v.passenger_tickets)


@register("row_count", "S-06", "flight_crew", "select count(*) as n_rows from flight_crew")
def _(v):
    return tables.count_rows(v.flight_crew)


@register(
    "table_subset", "S-04 F-13 P-22", "tickets",
    "select ticket_id, route_code, seats from tickets where class = 'B' and seats > 40",
)
def _(v):
    return tables.read_table(v.tickets, ["TICKET_ID", "ROUTE_CODE", "SEATS"], where="class = 'B' and seats > 40")


@register(
    "sql_with_parameters", "S-01 S-02 S-03 T-09", "tickets",
    """select class, count(*) as n_rows, cast(sum(total_amount) as double) as revenue from tickets
       where seats >= 10 and departure >= timestamp '1998-01-01' group by class order by class""",
)
def _(v):
    text = """select class as ` CLASS `, count(*) as n_rows, cast(sum(total_amount) as double) as Revenue
              from {tickets} where seats >= :seats and departure >= cast(:since as timestamp_ntz)
              group by class order by class"""
    return tables.read_sql(v.spark, text, {"seats": 10, "since": "1998-01-01"}, tickets=v.tickets)


_LEG_NAMES = {
    "route_code": " ROUTE_CODE", "origin": "Origin ", "destination": " Destination ", "parent_route": "PARENT ROUTE",
    "leg_number": "Leg Number", "distance": "DISTANCE", "flight_minutes": "Flight_Minutes",
}


def _unkempt(v: AirlineViews) -> DataFrame:
    """Routes under the kind of names a warehouse returns."""
    return v.routes.select(*[F.col(name).alias(heading) for name, heading in _LEG_NAMES.items()])


@register(
    "normalized_names", "P-01 X-03", "routes",
    'select * rename (leg_number as "leg number", parent_route as "parent route") from routes',
)
def _(v):
    return cols.normalize_names(_unkempt(v))


@register("standardized_names", "P-02 X-03", "routes", "select * from routes")
def _(v):
    return cols.standardize_names(_unkempt(v))


@register(
    "filter_equal", "F-11", "airplanes",
    "select aircraft_registration, model, seats_economy from airplanes where model = 'Brand#7'",
)
def _(v):
    chosen = cols.where_equal(v.airplanes, "model", "Brand#7")
    return cols.where_equal(chosen, "seats_economy", "All").select("aircraft_registration", "model", "seats_economy")


@register("airports", "S-08 S-11 S-12", "airports", "select * replace (cast(airport_tax as double) as airport_tax) from airports")
def _(v):
    return as_double(v.airports, "airport_tax")


# --- routes, fleet and tickets ----------------------------------------------------------


@register(
    "route_revenue_pattern", "A-37 J-14", "tickets routes",
    """select route_code, origin, destination, count(*) as tickets, cast(sum(total_amount) as double) as revenue,
              cast(sum(total_amount) as double) / count(total_amount) as avg_ticket_value
       from tickets left join routes using (route_code) group by route_code, origin, destination""",
)
def _(v):
    return network.route_revenue(v.tickets, v.routes)


@register(
    "revenue_per_crew_hour", "D-04", "tickets assignments",
    """select t.route_code, t.revenue, c.crew_hours,
              case when c.crew_hours <> 0 then t.revenue / c.crew_hours end as revenue_per_crew_hour
       from (select route_code, cast(sum(total_amount) as double) as revenue from tickets group by route_code) t
            left join (select route_code, coalesce(sum(flight_minutes), 0) / 60.0::double as crew_hours
                       from assignments group by route_code) c on c.route_code = t.route_code""",
)
def _(v):
    return network.revenue_per_crew_hour(v.tickets, _assignments(v))


@register(
    "weekly_sales", "D-05", "tickets",
    """select cast(date_trunc('week', departure) as date) as week_start, count(*) as tickets,
              cast(sum(total_amount) as double) as revenue from tickets group by 1""",
)
def _(v):
    return network.weekly_sales(v.tickets)


@register(
    "route_efficiency", "D-06", "flights tickets routes",
    """select r.route_code, r.origin, r.destination, cast(r.distance as bigint) as distance,
              cast(r.flight_minutes as bigint) as flight_minutes, coalesce(f.n, 0) as flights,
              coalesce(t.n, 0) as tickets, coalesce(t.amount, 0) as revenue,
              case when r.distance <> 0 then t.amount / r.distance end as revenue_per_distance,
              case when r.flight_minutes <> 0 then t.amount / t.n / r.flight_minutes end as fare_per_minute
       from routes r left join (select route_code, count(*) as n from flights group by route_code) f
                               on f.route_code = r.route_code
            left join (select route_code, count(*) as n, cast(sum(total_amount) as double) as amount
                       from tickets group by route_code) t on t.route_code = r.route_code""",
)
def _(v):
    return network.route_efficiency(v.flights, v.tickets, v.routes)


@register(
    "origin_minutes", "D-06", "flights routes",
    """select origin, count(*) as flights,
              cast(sum(flight_minutes) as double) / count(flight_minutes) as avg_flight_minutes
       from flights join routes using (route_code) group by origin""",
)
def _(v):
    return network.origin_minutes(v.flights, v.routes)


@register(
    "city_pairs", "D-07", "revenue",
    """select city, destination_city, cast(sum(revenue) as double) as total_revenue
       from revenue group by city, destination_city""",
)
def _(v):
    return network.city_pairs(_revenue(v))


@register(
    "continent_matrix", "D-07", "revenue",
    "select country, "
    + ", ".join(
        f"""cast(sum(revenue) filter (destination_continent = '{r}') as double) as "{r}\"""" for r in LISTED
    )
    + f""", cast(sum(revenue) filter (destination_continent is null or destination_continent not in {tuple(LISTED)}) as double) as other
        from revenue group by country""",
)
def _(v):
    return network.place_matrix(_revenue(v), "country", "destination_continent", LISTED)


def _fleet(v: AirlineViews) -> DataFrame:
    return network.fleet_use(v.flights, v.routes, v.airplanes, AS_OF)


register("fleet_use", "D-08", "fleet", "select * from fleet")(_fleet)


@register(
    "fuel_by_model", "D-08", "fleet",
    """select model, count(*) as aircraft, cast(sum(flights) as bigint) as flights,
              cast(sum(flight_minutes) as bigint) / 60.0::double as flight_hours,
              cast(sum(flight_minutes * fuel_gallons_hour) as bigint) / 60.0::double as fuel_gallons
       from fleet group by model""",
)
def _(v):
    return network.fuel_by_model(_fleet(v))


@register(
    "seat_histogram", "D-09", "airplanes",
    """select model, cast(floor((seats_business + seats_premium + seats_economy) / 10) * 10 as bigint) as seats_from,
              count(*) as aircraft from airplanes group by 1, 2""",
)
def _(v):
    return network.seat_histogram(v.airplanes)


_SEGMENT = """
    select {0}, count(distinct passenger_id) as passengers, count(*) as tickets,
           cast(sum(total_amount) as double) as revenue,
           count(*) / count(distinct passenger_id) as tickets_per_passenger,
           cast(sum(total_amount) as double) / count(distinct passenger_id) as spend_per_passenger{1}
    from {2} group by {0}"""


def _sales(v: AirlineViews) -> DataFrame:
    return passengers.passenger_sales(v.passenger_tickets, v.passengers)


@register(
    "monthly_ticket_states", "S-18 A-01 A-02", "tickets",
    """select cast(date_trunc('month', departure) as date) as at, route_code, class,
              cast(sum(airport_tax) as double) as airport_tax_sum, cast(sum(local_tax) as double) as local_tax_sum,
              cast(sum(total_amount) as double) as total_amount_sum, count(airport_tax) as airport_tax_n,
              count(local_tax) as local_tax_n, count(total_amount) as total_amount_n, count(*) as tickets
       from tickets group by all""",
)
def _(v):
    return as_double(facts.monthly_ticket_sums(v.tickets), *[f"{name}_sum" for name in facts.AMOUNTS])


@register("tickets_by_origin_merged", "A-01 S-18", "tickets_agg", "select * from tickets_agg")
def _(v):
    return facts.origin_means(facts.monthly_ticket_sums(v.tickets), v.routes)


@register(
    "passenger_sales_merged", "D-10 S-18", "sales",
    """select passenger_id, class, country, vipcard, birth_date, count(*) as tickets, cast(sum(total_amount) as double) as amount
       from sales group by all""",
)
def _(v):
    return as_double(passengers.sales_of_months(passengers.monthly_passenger_sums(v.passenger_tickets), v.passengers), "amount")


@register("passengers_by_country", "D-10 D-14", "sales", _SEGMENT.format("country", "", "sales"))
def _(v):
    return passengers.by_country(_sales(v))


@register(
    "passengers_by_vip", "D-10", "sales",
    _SEGMENT.format(
        "vipcard",
        ", cast(sum(total_amount) as double) / (select cast(sum(total_amount) as double) from sales) as share",
        "sales",
    ),
)
def _(v):
    return passengers.by_vip(_sales(v))


@register("passenger_class_by_vip", "D-10", "sales", _SEGMENT.format("vipcard, class", "", "sales"))
def _(v):
    return passengers.class_by_vip(_sales(v))


@register(
    "passengers_by_age", "D-10", "sales",
    _SEGMENT.format(
        "age_from", "",
        """(select *, case when age >= 60 then 60 when age >= 45 then 45 when age >= 30 then 30
                           when age >= 18 then 18 when age >= 0 then 0 end as age_from
            from (select *, datesub('year', birth_date, date '2025-01-01') as age from sales))""",
    ),
)
def _(v):
    return passengers.by_age(_sales(v), AS_OF)


@register(
    "ticket_value_spread", "D-11", "tickets",
    """select class, count(value) as n, min(value) as min_value, round(quantile_cont(value, 0.25), 6) as q1_value,
              round(quantile_cont(value, 0.5), 6) as median_value, round(quantile_cont(value, 0.75), 6) as q3_value,
              max(value) as max_value
       from (select class, cast(total_amount as double) as value from tickets) group by class""",
)
def _(v):
    return rounded(network.ticket_value_spread(v.tickets), 6, "q1_value", "median_value", "q3_value")


@register(
    "tax_by_geography", "D-12", "tickets routes airports",
    """select continent, country, origin, cast(sum(k.airport_tax) as double) / count(*) as avg_airport_tax,
              count(*) as tickets, cast(sum(total_amount) as double) as revenue
       from tickets k join routes using (route_code) join airports on iata_code = origin
       group by rollup (continent, country, origin)""",
)
def _(v):
    return network.tax_by_geography(v.tickets, v.routes, v.airports)


@register(
    "destination_sales", "D-12", "tickets routes",
    """select destination, count(*) as tickets, cast(sum(total_amount) as double) as revenue
       from tickets join routes using (route_code) group by destination""",
)
def _(v):
    return network.destination_sales(v.tickets, v.routes)


@register(
    "route_tax_burden", "D-13", "tickets routes",
    """select t.*, origin, destination, total_tax / revenue as tax_share
       from (select route_code, count(*) as tickets, cast(sum(airport_tax + local_tax) as double) as total_tax,
                    cast(sum(total_amount) as double) as revenue from tickets group by route_code) t
            left join routes using (route_code) order by tax_share desc, route_code limit 20""",
)
def _(v):
    return network.route_tax_burden(v.tickets, v.routes)


# --- data quality ------------------------------------------------------------------------


@register(
    "dq_duplicate_tickets", "DQ-01", "tickets",
    "select ticket_id, count(*) as n_rows from tickets group by ticket_id having count(*) > 1",
)
def _(v):
    return quality.duplicate_keys(v.tickets, ["ticket_id"])


def _key_tables(v: AirlineViews) -> dict[str, DataFrame]:
    return {
        "airplanes": v.airplanes, "airports": v.airports, "flights": v.flights, "routes": v.routes,
        "flight_crew": v.flight_crew, "staff": v.staff, "tickets": v.tickets, "passengers": v.passengers,
    }


def _keys_sql() -> str:
    keys = (
        ("airplanes", "aircraft_registration"), ("airports", "iata_code"),
        ("flights", "flight_id, route_code, departure"), ("flights", "flight_id, flight_leg, departure"),
        ("routes", "route_code"), ("flight_crew", "empno, flight_id, route_code, departure"),
        ("staff", "empno"), ("tickets", "ticket_id"), ("passengers", "id"),
    )
    return " union all ".join(
        f"""select '{t}' as "table", '{k}' as "key", count(*) as n_duplicate_keys
            from (select {k} from {t} group by {k} having count(*) > 1)"""
        for t, k in keys
    )


@register("dq_keys", "DQ-01 DQ-02", "airplanes airports flights routes flight_crew staff tickets passengers", _keys_sql())
def _(v):
    return quality.declared_key_report(_key_tables(v))


def _references_sql() -> str:
    flight = "flight_id, route_code, departure"
    references = (
        ("flights", "route_code", "routes", "route_code"), ("flights", "airplane", "airplanes", "aircraft_registration"),
        ("routes", "origin", "airports", "iata_code"), ("routes", "destination", "airports", "iata_code"),
        ("routes", "parent_route", "routes", "route_code"), ("flight_crew", "empno", "staff", "empno"),
        ("flight_crew", flight, "flights", flight), ("tickets", "route_code", "routes", "route_code"),
        ("tickets", flight, "flights", flight), ("tickets", "passenger_id", "passengers", "id"),
    )
    return " union all ".join(
        f"""select '{t}' as "table", '{c}' as "columns", '{target}' as target,
                   count(distinct ({c})) as n_missing, count(*) as n_rows
            from {t} where {" and ".join(f"{x} is not null" for x in c.split(", "))}
                 and ({c}) not in (select ({key}) from {target})"""
        for t, c, target, key in references
    )


@register("dq_references", "DQ-03 DQ-04", "flights routes airplanes airports flight_crew staff tickets passengers", _references_sql())
def _(v):
    return quality.declared_reference_report(_key_tables(v) | {"tickets": v.passenger_tickets})


@register(
    "dq_crew_without_staff", "DQ-04", "flight_crew staff",
    """select empno, count(*) as n_rows from flight_crew c
       where not exists (select 1 from staff s where s.empno = c.empno) group by empno""",
)
def _(v):
    return quality.orphans(v.flight_crew, ["empno"], v.staff, ["empno"])


def _counts_sql(table: str, label: str, tests: dict[str, str], absent: str = "null::bigint", lacking: str = "") -> str:
    """A row per test; the columns in `lacking` are not in the view."""
    return " union all ".join(
        f"""select '{table}' as "table", '{c}' as "column", {str(c not in lacking.split()).lower()} as present,
                   {absent if c in lacking.split() else f"count(*) filter ({test})"} as {label} from {table} group by all"""
        if c not in lacking.split() or absent == "count(*)" else
        f"""select '{table}' as "table", '{c}' as "column", false as present, {absent} as {label}"""
        for c, test in tests.items()
    )


@register("dq_nulls", "DQ-05", "routes", _counts_sql("routes", "n_nulls", {c: f"{c} is null" for c in _ROUTE_TYPES}))
def _(v):
    return quality.null_counts(v.routes, "routes", v.routes.columns)


_REQUIRED = {
    "airplanes": ("aircraft_registration model build_date fuel_gallons_hour maintenance_last_acheck maintenance_last_bcheck "
                  "maintenance_takeoffs maintenance_flight_hours total_flight_distance", ""),
    "airports": ("iata_code airport city country continent timezone latitude longitude", ""),
    "flights": ("flight_id flight_leg frequency route_code departure arrival airplane", "frequency arrival"),
    "routes": ("route_code origin destination parent_route leg_number", ""),
    "flight_crew": ("empno flight_id route_code departure", ""),
    "staff": ("empno firstnme lastname passport birthdate hiredate division department marital_status",
              "passport birthdate division marital_status"),
}


@register(
    "dq_required", "DQ-05", " ".join(_REQUIRED),
    " union all ".join(
        _counts_sql(t, "n_nulls", {c: f"{c} is null" for c in names.split()}, "count(*)", lacking)
        for t, (names, lacking) in _REQUIRED.items()
    ),
)
def _(v):
    return quality.declared_null_report(_key_tables(v))


@register(
    "dq_range", "DQ-06", "flights",
    "select flight_id, route_code, departure, airplane from flights where year(departure) not between 1996 and 2000",
)
def _(v):
    return quality.outside_years(v.flights, 1996, 2000).select("flight_id", "route_code", "departure", "airplane")


_LENGTHS = {
    "airplanes": ("strlen", {"aircraft_registration": 7, "model": 25}, ""),
    "airports": ("strlen", {"iata_code": 3, "airport": 50, "city": 20, "country": 20, "continent": 20, "timezone": 6}, ""),
    "flights": ("strlen", {"flight_id": 6, "frequency": 2, "route_code": 4, "airplane": 7}, "frequency"),
    "routes": ("strlen", {"route_code": 4, "origin": 3, "destination": 3, "parent_route": 6}, ""),
    "flight_crew": ("length", {"flight_id": 6, "route_code": 4}, ""),
    "staff": (
        "length",
        {"firstnme": 20, "midinit": 1, "lastname": 20, "gender": 1, "passport": 12, "division": 40, "department": 40,
         "marital_status": 40, "phone": 9, "email": 30},
        "midinit passport division marital_status phone email",
    ),
}


@register(
    "dq_length", "DQ-07", " ".join(_LENGTHS),
    " union all ".join(
        _counts_sql(t, "n_too_long", {c: f"{size}({c}) > {n}" for c, n in limits.items()}, lacking=lacking)
        for t, (size, limits, lacking) in _LENGTHS.items()
    ),
)
def _(v):
    return quality.declared_length_report(_key_tables(v))


_ROUTE_RULES = {
    **{f"null {c}": f"{c} is null" for c in ("route_code", "origin", "destination", "parent_route", "leg_number")},
    **{f"long {c}": f"strlen({c}) > {n}" for c, n in {"route_code": 4, "origin": 3, "destination": 3, "parent_route": 6}.items()},
}


@register(
    "dq_broken_rules", "DQ-05 DQ-07", "routes",
    "select concat_ws(', ', " + ", ".join(f"case when {test} then '{rule}' end" for rule, test in _ROUTE_RULES.items())
    + ") as broken, count(*) as n_rows from routes group by all",
)
def _(v):
    return screening.broken_rules(v.routes, "routes")


@register(
    "dq_broken_flight_years", "DQ-06", "flights",
    """select case when year(departure) not between 1996 and 2000 then 'year departure' else '' end as broken,
              count(*) as n_rows from flights group by all""",
)
def _(v):
    rules = screening.row_rules(v.flights, "flights", 1996, 2000)
    year = screening.mask({"year departure": rules["year departure"]})
    counts = v.flights.groupBy(year.alias("bits")).agg(F.count("*").alias("n_rows"))
    return counts.select(F.array_join(screening.names_of(["year departure"], F.col("bits")), ", ").alias("broken"), "n_rows")
