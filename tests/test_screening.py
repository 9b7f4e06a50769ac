"""Rows set apart on the way in, and places with their months."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyfacts.functions import columns as cols
from skyfacts.operators import quality, revenue, screening
from skyfacts.plans import facts

SCHEMA = "empno int, flight_id string, route_code string, departure timestamp_ntz, note string"
GOOD = (1, "F1", "R1", datetime(2020, 5, 1, 8), "a")
ROWS = [
    GOOD, GOOD,
    (None, "F1", "R1", datetime(2020, 5, 1, 8), None),
    (2, "F1234567", "R1", datetime(2031, 1, 1), "three"),
    (3, None, "éééé", datetime(2009, 12, 31, 23, 59), None),  # four characters are within the limit
    (4, "F1", "R1", None, None),
]


def test_kept_and_quarantined_rows_are_the_input(spark, rows, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = screening.write_screened(df, "flight_crew", str(tmp_path / "crew"))
    assert rows(found.kept) == rows(df.where("empno = 1"))
    assert rows(found.kept.unionByName(found.quarantine.drop(screening.MASK))) == rows(df)
    assert {r.empno: r[screening.MASK] for r in found.quarantine.collect()} == {
        None: ["null empno"], 2: ["long flight_id", "year departure"], 3: ["null flight_id", "year departure"], 4: ["null departure"],
    }
    assert (found.rows, found.quarantined) == (6, 4)
    assert found.violations == {
        "null empno": 1, "null flight_id": 1, "null route_code": 0, "null departure": 1,
        "long flight_id": 1, "long route_code": 0, "year departure": 2,
    }
    nulls = {f"null {r['column']}": r.n_nulls for r in quality.null_counts(df, "flight_crew").collect()}
    assert nulls == {rule: n for rule, n in found.violations.items() if rule.startswith("null")}


def test_empty_absent_and_clashing(spark, tmp_path):
    none = screening.write_screened(spark.createDataFrame([], SCHEMA), "flight_crew", str(tmp_path / "none"))
    assert none.kept.collect() == none.quarantine.collect() == [] and none.rows == none.quarantined == 0
    lacking = screening.write_screened(spark.createDataFrame([GOOD], SCHEMA).drop("empno"), "flight_crew", str(tmp_path / "lacking"))
    assert lacking.quarantined == lacking.rows == lacking.violations["null empno"] == 1
    with pytest.raises(ValueError, match="accepted"):
        screening.write_screened(spark.createDataFrame([GOOD], SCHEMA).withColumn("accepted", F.lit(1)), "flight_crew", str(tmp_path / "clash"))


def test_options_and_bounds_come_from_the_dictionary(views, rows):
    fact = revenue.normalize_revenue(facts.revenue_fact(views.tickets, views.routes, views.airports)).cache()
    places = revenue.place_months(fact).cache()
    for chosen in ({}, {"continent": "ASIA"}, {"continent": "ASIA", "country": "NATION_7"}, {"continent": "nowhere"}):
        whole, small = revenue.at_place(fact, **chosen), revenue.at_place(places, **chosen)
        for level in revenue.LEVELS:
            assert rows(cols.option_values(small, level)) == rows(cols.option_values(whole, level))
        assert rows(revenue.month_bounds(small)) == rows(revenue.month_bounds(whole))
    fact.unpersist(), places.unpersist()
