"""Rules on nulls, zeros, ties, order and dates, each on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyfacts.functions import aggregates, columns, dates
from skyfacts.operators import capacity, network, passengers, profiling, quality, revenue, staff, tax
from skyfacts.plans import facts
from skyfacts.schemas import SchemaError, conform, require_columns


def one(df):
    (row,) = df.collect()
    return row


def test_sum_of_nothing_is_zero(spark):
    nulls = spark.createDataFrame([("a", None), ("a", None)], "k string, x int")
    assert one(nulls.agg(aggregates.sum0("x").alias("s"))).s == 0
    assert one(nulls.where("false").agg(aggregates.sum0("x").alias("s"))).s == 0


def test_null_is_a_value_for_n_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), ("b", None)], "k string, x int")
    found = {r.k: r.n for r in df.groupBy("k").agg(aggregates.n_unique("x").alias("n")).collect()}
    assert found == {"a": 2, "b": 1}
    assert one(df.where("false").agg(aggregates.n_unique("x").alias("n"))).n == 0


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(4, 2), (4, 0), (4, None)], "a int, b int")
    assert [r.x for r in df.select(aggregates.divide("a", "b").alias("x")).collect()] == [2.0, None, None]


def test_descending_order_puts_null_first(spark):
    counts = spark.createDataFrame([("x", 3), ("y", None), ("z", 5)], "department string, staff_count bigint")
    hours = spark.createDataFrame([("z", 120)], "department string, flight_minutes bigint")
    stats = staff.department_stats(counts, hours)
    assert [r.department for r in stats.collect()] == ["y", "z", "x"]
    assert [tuple(r) for r in staff.top_departments_by_hours(stats, 2).collect()] == [("z", 5, 2.0), ("x", 3, 0.0)]


def test_iso_week_and_weekday_at_year_end(spark):
    df = spark.createDataFrame(
        [(f"F{i}", "R1", d, 1, 2) for i, d in enumerate((datetime(2020, 12, 31), datetime(2021, 1, 3), datetime(2021, 1, 4)))],
        "flight_id string, route_code string, departure timestamp_ntz, tickets_sold bigint, total_capacity int",
    )
    found = [(r.week, r.day_of_week, r.year_month) for r in capacity.occupancy(df).orderBy("departure").collect()]
    assert found == [(53, 4, "2020-12"), (53, 7, "2021-01"), (1, 1, "2021-01")]
    names = {r.day_of_week: r.day_name for r in capacity.by_weekday(capacity.occupancy(df)).collect()}
    assert names == {1: "Monday", 4: "Thursday", 7: "Sunday"}


def test_flight_without_seats_does_not_count(spark):
    df = spark.createDataFrame(
        [("F1", "R1", datetime(2024, 1, 1), 5, 0), ("F1", "R1", datetime(2024, 1, 2), 19, 10), ("F2", "R2", datetime(2024, 1, 1), 1, 0)],
        "flight_id string, route_code string, departure timestamp_ntz, tickets_sold bigint, total_capacity int",
    )
    full = capacity.occupancy(df)
    kpis = one(capacity.occupancy_kpis(full))
    assert (kpis.avg_capacity, kpis.max_capacity, kpis.flights, kpis.routes) == (1.9, 1.9, 2, 2)
    flights = capacity.by_flight(full)
    assert [(r.flight_id, r.avg_capacity, r.observations) for r in flights.collect()] == [("F2", None, 1), ("F1", 1.9, 2)]
    assert [tuple(r) for r in capacity.top_flights(flights).collect()] == [("F1", "190.0%", "R1")]
    assert tuple(one(capacity.occupancy_thresholds(full))) == (1, 0, 2)


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2021-05-01", "2021-02-01", (date(2021, 2, 1), date(2021, 5, 1))),
        ("bad", "also bad", (date(2020, 1, 1), date(2025, 12, 31))),
        (datetime(2021, 5, 1, 12), "2021-06-30T10:00:00", (date(2021, 5, 1), date(2021, 6, 30))),
        (None, date(2021, 1, 1), (date(2020, 1, 1), date(2021, 1, 1))),
    ],
)
def test_date_bounds(start, end, expected):
    assert dates.ordered_range(start, end) == expected


def test_departure_window_equals_month_filter():
    assert dates.departure_window("2021-01-15", "2021-03-20") == (datetime(2021, 2, 1), datetime(2021, 4, 1))
    assert dates.departure_window("2021-01-01", "2021-12-01") == (datetime(2021, 1, 1), datetime(2022, 1, 1))


REVENUE = "year int, month {0}, continent string, country string, city string, route_code string, origin string, \
destination string, destination_continent string, {1} string, destination_city string, class string, revenue double"


def revenue_rows(spark, months, kind="date", country="destination_conutry"):
    data = [(2021, m, "E", "FR", "PAR", f"R{i}", "A", "B", "E", "ES", "MAD", c, v) for i, (m, c, v) in enumerate(months)]
    return spark.createDataFrame(data, REVENUE.format(kind, country))


def test_revenue_normalisation(spark):
    text = revenue_rows(spark, [("2021-02-01", "E", 1.0), ("2021", "E", 2.0), ("2021-02", "E", 3.0), ("x", "E", 4.0)], "string")
    found = revenue.normalize_revenue(text.withColumnRenamed("revenue", " REVENUE "))
    assert [r.year_month for r in found.collect()] == [date(2021, 2, 1), None, None, None]
    assert {"route", "destination_country"} <= set(found.columns) and "destination_conutry" not in found.columns
    stamped = revenue_rows(spark, [(datetime(2021, 2, 1, 5), "E", 1.0)], "timestamp_ntz", "destination_country")
    assert one(revenue.normalize_revenue(stamped)).year_month == date(2021, 2, 1)


def test_revenue_range_and_leaders(spark):
    months = [(date(2021, 1, 1), "E", 5.0), (date(2021, 2, 1), "B", 7.0), (date(2021, 3, 1), "Z", 7.0), (date(2021, 3, 1), None, None)]
    df = revenue.normalize_revenue(revenue_rows(spark, months))
    # A start inside a month drops that month; an end inside one keeps it.
    assert one(revenue.total_revenue(df, "2021-01-02", "2021-03-15")).total_revenue == 14.0
    assert one(revenue.total_revenue(df, "2021-03-15", "2021-01-02")).total_revenue == 14.0
    assert one(revenue.total_revenue(df, "1999-01-01", "1999-02-01")).total_revenue == 0.0
    assert revenue.top_route(df, "1999-01-01", "1999-02-01").count() == 0
    by_class = revenue.revenue_by_class(df, "2021-01-01", "2021-12-31")
    assert {(r["class"], r.total_revenue) for r in by_class.collect()} == {("E", 5.0), ("B", 7.0), ("Z", 7.0), (None, 0.0)}
    assert one(revenue.leading_class(by_class)).class_name == "Business"
    assert one(revenue.leading_class(by_class.where("class = 'Z'"))).class_name is None
    shares = revenue.with_share(by_class).collect()
    assert sum(r.share for r in shares) == pytest.approx(1)


def test_optional_filters(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "p"), (None, "q")], "a string, b string")
    assert columns.where_equal(df, "a", "All").count() == 3
    assert columns.where_equal(df, "a", None).count() == 3
    assert columns.where_equal(df, "a", "x").count() == 1
    assert columns.where_in(df, "a", []).count() == 2
    assert [r.a for r in columns.option_values(df, "a").collect()] == ["x", "y"]
    assert revenue.at_place(df.toDF("continent", "country"), "All", "p", None).count() == 2


def test_text_helpers(spark):
    df = spark.createDataFrame([("saint-denis o'hare NEW yORK",), (None,)], "t string")
    assert [r.x for r in df.select(columns.title_case(F.col("t")).alias("x")).collect()] == ["Saint-Denis O'Hare New York", None]
    numbers = spark.createDataFrame([(1234567.5, 0.9325), (None, None)], "n double, p double")
    shown = numbers.select(columns.amount_text(F.col("n")).alias("n"), columns.percent_text(F.col("p")).alias("p")).collect()
    assert (shown[0].n, shown[0].p, shown[1].n) == ("1,234,568", "93.2%", "0")


def test_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "` Flight ID ` int, `PRICE` double, `Note` string")
    assert columns.normalize_names(df).columns == ["flight id", "price", "note"]
    clean = columns.standardize_names(df)
    assert clean.columns == ["flight_id", "price", "note"]
    assert columns.text_columns(clean) == ["note"] and columns.numeric_columns(clean) == ["flight_id", "price"]


def test_lenient_dates(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("2024",), (None,)], "d string")
    found = dates.add_date_parts(df, "d").collect()
    assert [(r.d, r.year, r.month, r.weekday) for r in found] == [
        (None, None, None, None), (date(2024, 2, 29), 2024, 2, 4), (None,) * 4, (None,) * 4
    ]
    assert [tuple(r) for r in profiling.monthly_counts(df, "d").collect()] == [(None, None, 3), (2024, 2, 1)]


def assignments(spark, data):
    schema = """empno int, firstnme string, lastname string, department string, flight_id string, route_code string,
                departure timestamp_ntz, distance bigint, flight_minutes bigint"""
    return staff.with_period(spark.createDataFrame(data, schema))


def test_staff_kpis(spark):
    counts = spark.createDataFrame([("X", 4), ("Y", None)], "department string, staff_count bigint")
    flown = assignments(spark, [
        (1, "a", "b", "X", "F1", "R1", datetime(2021, 1, 1), 100, 60),
        (1, "a", "b", "X", "F2", "R1", datetime(2022, 1, 1, 12), 100, 60),
        (2, "c", "d", "X", "F1", "R2", datetime(2021, 1, 1), None, None),
    ])
    years = 365 / 365.5
    assert tuple(one(staff.staff_kpis(counts, flown))) == (4, 100 / years, 60 / 60.0 / years)
    day = flown.where("year = 2021")
    assert tuple(one(staff.staff_kpis(counts, day))) == (4, 50.0, 0.5)
    assert tuple(one(staff.staff_kpis(counts, flown.where("false")))) == (4, 0.0, 0.0)


def test_utilisation_flags_can_both_hold(spark):
    alone = assignments(spark, [(1, "a", "b", None, "F1", "R1", datetime(2021, 1, 1), 1, 90), (1, "a", "b", None, "F2", None, datetime(2021, 1, 2), 1, None)])
    row = one(staff.staff_utilisation(alone))
    assert (row.total_flights, row.total_hours, row.unique_routes) == (2, 1.5, 2)
    assert row.is_overused and row.is_underused and row.p90_threshold == row.p10_threshold == 1.5
    assert staff.staff_utilisation(alone.where("false")).count() == 0


def test_crew_means_skip_uncrewed_flights_but_sums_count_them_as_zero(spark):
    usage = spark.createDataFrame(
        [("F1", "R1", "A", "B", datetime(2021, 1, 1), 4, "M", 2), ("F2", "R1", "A", "B", datetime(2021, 2, 1), 4, "M", None)],
        "flight_id string, route_code string, origin string, destination string, departure timestamp_ntz, required_crew bigint, airplane_model string, used_crew bigint",
    )
    model = one(staff.aircraft_crew(usage))
    assert (model.avg_required_crew, model.avg_used_crew, model.crew_difference) == (4.0, 2.0, -2.0)
    route = one(staff.route_crew_gap(usage))
    assert (route.total_flights, route.total_actual_crew, route.crew_gap, route.route_label) == (2, 2, 6, "A → B")
    assert one(staff.route_crew_gap(usage.drop("origin"))).route_label == "R1"
    short = one(staff.understaffing_by_route(usage))
    assert (short.missing_slots, short.gap_rate) == (6, 1.0)
    assert staff.departing_in(usage, 2020, 2020).count() == 0 and staff.departing_in(usage).count() == 2


def test_missing_geography_survives_the_tax_report(spark):
    agg = spark.createDataFrame(
        [("A", 1.0, 1.0, 20.0, 20.0, 1), ("B", 1.0, 2.0, 0.0, 0.0, 2)],
        "origin string, avg_airport_tax double, avg_local_tax double, avg_ticket_value double, total_revenue double, ticket_count bigint",
    )
    places = spark.createDataFrame(
        [("A", "Alpha", "C", "K", "Q", 1.0, 2.0)],
        "iata_code string, airport string, city string, country string, continent string, latitude double, longitude double",
    )
    report = tax.airport_tax_report(agg, places)
    # A null share sorts first, as its ticket value is zero.
    assert [(r.origin, r.avg_tax_pct, r.origin_city) for r in report.collect()] == [("B", None, None), ("A", 10.0, "C")]
    assert tax.filter_tax(report).count() == 1
    assert tax.filter_tax(report, tax_range=(10.0, 10.0)).count() == 1
    assert tax.filter_tax(report, tax_range=(10.1, None)).count() == 0
    assert tax.located(report).count() == 1
    assert one(tax.tax_kpis(report.where("false"))).total_tickets == 0


def test_duplicate_crew_rows_add_up(spark):
    crew = spark.createDataFrame([(1, "F1", "R1", datetime(2021, 1, 1))] * 2, "empno int, flight_id string, route_code string, departure timestamp_ntz")
    legs = spark.createDataFrame([("R1", 100, 30)], "route_code string, distance int, flight_minutes smallint")
    people = spark.createDataFrame([(2, "a", "b", "X")], "empno int, firstnme string, lastname string, department string")
    row = one(facts.staff_assignments(crew, legs, people))
    assert (row.distance, row.flight_minutes, row.department) == (200, 60, None)
    assert one(facts.crew_used(crew)).used_crew == 1


def test_age_bands(spark):
    sales = spark.createDataFrame(
        [(1, "E", 1, 10.0, "FR", 1, date(2007, 1, 2)), (2, "E", 1, 10.0, "FR", 0, date(2007, 1, 1)), (3, "E", 1, 10.0, "FR", 0, None)],
        "passenger_id bigint, class string, tickets bigint, amount double, country string, vipcard int, birth_date date",
    )
    found = passengers.by_age(sales, date(2025, 1, 1)).collect()
    assert [(r.age_from, r.passengers) for r in found] == [(None, 1), (0, 1), (18, 1)]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    found = [tuple(r) for r in profiling.profile(df).collect()]
    assert found == [("b", "string", 2, 2, 2 / 3), ("a", "int", 1, 2, 1 / 3)]
    assert [tuple(r) for r in profiling.profile(df.where("false")).collect()] == [("a", "int", 0, 0, 0.0), ("b", "string", 0, 0, 0.0)]


def test_median_of_an_even_count_and_of_null_category(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), (None, 7), ("b", None)], "k string, v int")
    found = {r.k: (r.n_rows, r.avg_v, r.median_v) for r in profiling.numeric_summary(df, "k", "v").collect()}
    assert found == {"a": (2, 2.5, 2.5), None: (1, 7.0, 7.0), "b": (1, None, None)}


def test_quality_checks(spark):
    df = spark.createDataFrame([("ab", 1), ("ab", 1), ("abcd", None)], "iata_code string, x int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["iata_code"]).collect()] == [("ab", 2)]
    long = {r.column: (r.present, r.n_too_long) for r in quality.too_long(df, "airports").collect()}
    assert long.pop("iata_code") == (True, 1) and set(long.values()) == {(False, None)} and len(long) == 5
    assert [tuple(r) for r in quality.null_counts(df, "airports", ["x"]).collect()] == [("airports", "x", True, 1)]
    nulls = {r.column: (r.present, r.n_nulls) for r in quality.null_counts(df, "airports").collect()}
    assert nulls.pop("iata_code") == (True, 0) and set(nulls.values()) == {(False, 3)} and len(nulls) == 7
    with pytest.raises(SchemaError):
        quality.declared_reference_report({"flights": df, "routes": df})
    target = spark.createDataFrame([("ab",)], "code string")
    assert [tuple(r) for r in quality.orphans(df, ["iata_code"], target, ["code"]).collect()] == [("abcd", 1)]
    flown = spark.createDataFrame([(datetime(2009, 12, 31, 23, 59, 59),), (datetime(2026, 12, 31, 23, 59, 59),), (datetime(2027, 1, 1),)], "departure timestamp_ntz")
    assert quality.outside_years(flown).count() == 2


def test_lengths_are_bytes_or_characters(spark):
    city = "Águeda e São João Mx"  # 20 characters, 24 bytes
    airports = spark.createDataFrame([(city,)], "city string")
    staff_rows = spark.createDataFrame([(city,)], "firstnme string")
    assert {r.column: r.n_too_long for r in quality.too_long(airports, "airports").collect()}["city"] == 1
    assert {r.column: r.n_too_long for r in quality.too_long(staff_rows, "staff").collect()}["firstnme"] == 0


def test_capacity_keeps_every_flight(spark):
    key = "flight_id string, route_code string, departure timestamp_ntz"
    at = datetime(2024, 1, 1)
    flown = spark.createDataFrame([("F1", "R1", at, "P1"), ("F2", "R1", at, "P1"), ("F3", "R1", at, "P9")], f"{key}, airplane string")
    sold = spark.createDataFrame([("F1", "R1", at), ("F1", "R1", at), ("F3", "R1", at)], key)
    planes = spark.createDataFrame([("P1", 1, 1, 2)], "aircraft_registration string, seats_business smallint, seats_premium smallint, seats_economy smallint")
    made = facts.capacity(flown, sold, planes)
    assert {r.flight_id: (r.tickets_sold, r.total_capacity) for r in made.collect()} == {"F1": (2, 4), "F2": (0, 4), "F3": (1, None)}
    assert tuple(one(capacity.occupancy_thresholds(capacity.occupancy(made)))) == (0, 1, 1)


def test_tickets_of_unknown_passengers_keep_their_revenue(spark):
    sold = spark.createDataFrame([(1, "E", 5.0), (2, "E", 7.0)], "passenger_id bigint, class string, total_amount double")
    who = spark.createDataFrame([(1, "X", 1, None)], "id bigint, country string, vipcard int, birth_date date")
    found = passengers.by_country(passengers.passenger_sales(sold, who)).collect()
    assert {r.country: r.revenue for r in found} == {"X": 5.0, None: 7.0}


def test_unlisted_destinations_share_a_column(spark):
    sold = spark.createDataFrame([("A", "X", 1.0), ("A", "Y", 2.0), ("A", None, 4.0)], "country string, place string, revenue double")
    assert one(network.place_matrix(sold, "country", "place", ["X"])).asDict() == {"country": "A", "X": 1.0, "other": 6.0}


def test_revenue_is_cut_by_any_place_and_class(spark):
    names = ["class", "origin", "destination_city"]
    sold = spark.createDataFrame([("E", "A", "c", 1.0), ("B", "A", "c", 2.0), ("E", "B", "d", 4.0)], [*names, "revenue"])
    assert revenue.at_place(sold, **{"class": "E", "destination_city": "c", "origin": "All"}).count() == 1
    with pytest.raises(ValueError, match="nowhere"):
        revenue.at_place(sold, nowhere="x")


def test_describe_covers_text_and_dates(spark):
    df = spark.createDataFrame([("b", date(2020, 1, 2), 1), ("a", None, 3), (None, date(2019, 1, 1), None)], "k string, d date, v int")
    found = {r.column: r for r in profiling.describe(df).collect()}
    assert (found["k"]["count"], found["k"].null_count, found["k"].first, found["k"].last, found["k"].mean) == (2, 1, "a", "b", None)
    assert (found["d"].first, found["d"].last) == ("2019-01-01", "2020-01-02")
    assert (found["v"].min, found["v"].p50, found["v"].max, found["v"].first) == (1.0, 3.0, 3.0, None)


def test_conform_trims_padded_keys(spark):
    padded = spark.createDataFrame([("AB ", "x", 5, "kept")], "iata_code string, airport string, latitude int, note string")
    others = ["city", "country", "continent", "timezone", "longitude", "airport_tax"]
    made = conform(padded, "airports", extra=["note"], absent=others)
    assert made.columns == ["iata_code", "airport", "city", "country", "continent", "timezone", "latitude", "longitude", "airport_tax", "note"]
    assert (one(made).iata_code, one(made).latitude, one(made).city, one(made).note) == ("AB", 5.0, None, "kept")
    for bad in ({"absent": others[1:]}, {"absent": others, "extra": ["gone"]}):
        with pytest.raises(SchemaError):
            conform(padded, "airports", **bad)
    with pytest.raises(SchemaError):
        conform(padded.drop("iata_code"), "airports", absent=others)
    with pytest.raises(SchemaError):
        require_columns(padded, ["nothing"], "padded")


def test_route_reports_keep_unknown_routes(spark):
    sold = spark.createDataFrame([("R1", 10.0), ("R9", 5.0)], "route_code string, total_amount double")
    legs = spark.createDataFrame([("R1", "A", "B", 0, 10)], "route_code string, origin string, destination string, distance int, flight_minutes int")
    assert [(r.route_code, r.origin) for r in network.route_revenue(sold, legs).collect()] == [("R1", "A"), ("R9", None)]
    row = one(network.route_efficiency(sold.where("false"), sold, legs))
    assert (row.flights, row.tickets, row.revenue_per_distance, row.fare_per_minute) == (0, 1, None, 1.0)


def test_sketched_profile(spark, views):
    """Estimates within four standard errors on a whole table, whether from one state or from many."""
    exact = {r["column"]: r for r in profiling.profile(views.passenger_tickets).collect()}
    by_class = profiling.profile_of_states(profiling.profile_states(views.passenger_tickets, "class"))
    for found in (profiling.profile(views.passenger_tickets, approx=True), by_class):
        for r in found.collect():
            want = exact[r["column"]]
            assert (r["dtype"], r["nulls"], r["null_rate"]) == (want["dtype"], want["nulls"], want["null_rate"])
            assert abs(r["n_unique"] - want["n_unique"]) <= max(1, 4 * 0.0065 * want["n_unique"])
    odd = spark.createDataFrame([(1, -0.0, None, [1], True), (2, 0.0, None, [1], False), (2, float("nan"), b"x", [2], None)], "a short, b double, c binary, d array<int>, e boolean")
    assert {r["column"]: (r["nulls"], r["n_unique"]) for r in profiling.profile(odd, approx=True).collect()} == {"a": (0, 2), "b": (0, 2), "c": (2, 2), "d": (0, 2), "e": (1, 3)}
    assert {(r["nulls"], r["n_unique"], r["null_rate"]) for r in profiling.profile(odd.limit(0), approx=True).collect()} == {(0, 0, 0.0)}


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("20230501", date(2023, 5, 1)), ("2023-05-01", date(2023, 5, 1)), ("2023-05-01T10:00", date(2023, 5, 1)), ("2023-W18", date(2023, 5, 1)),
        ("2023W182", date(2023, 5, 2)), ("2023-W18-7", date(2023, 5, 7)), (datetime(2023, 5, 1, 9), date(2023, 5, 1)),
        ("2023-0501", None), ("202305-01", None), ("20230230", None), ("2023050112", None), ("2023-W54", None), ("2023W00", None), ("", None), (None, None), ("0000-01-01", None),
    ],
)
def test_iso_days(text, day):
    assert dates.to_date(text, date(1, 1, 1)) == (day or date(1, 1, 1))
