"""Versions: refreshes equal full runs, readers keep what they opened, and changed inputs are noticed."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyfacts.functions.dates import in_years
from skyfacts.plans import published
from skyfacts.plans.prepare import read_raw
from skyfacts.sources.files import fingerprint
from skyfacts.sources.prepared import MissingInputs, materialize
from skyfacts.sources.versions import ConflictingRun, Store
from test_sources import ABSENT, RAW


def save(views, root, names=(*RAW, "tickets"), change=lambda df: df):
    for name in names:
        table = views.passenger_tickets if name == "tickets" else getattr(views, name)
        change(table).write.mode("overwrite").parquet(f"{root}/{name}")


def run_of(spark, root, seats="seats", **parameters):
    return published.Run(read_raw(spark, root, extra={"tickets": ["seats"]}, absent=ABSENT), seats, **parameters)


def contents(version, rows):
    return {name: rows(version.read(name)) for name in published.INPUTS}


@pytest.fixture(scope="module")
def raw_root(views, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    save(views, root)
    return root


@pytest.fixture(scope="module")
def first(spark, raw_root, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    return published.publish(store, run_of(spark, raw_root))


def moved(df):
    """1996 loses its rows, half of 1997's are gone, and some of 1998's fly a day later; all other years are as they were."""
    half = F.xxhash64(*[c for c in ("flight_id", "route_code") if c in df.columns]) % 2 == 0
    kept = df.where(~in_years("departure", 1996, 1996) & ~(in_years("departure", 1997, 1997) & half))
    later = in_years("departure", 1998, 1998) & (F.month("departure") < 6) & half
    return kept.withColumn("departure", F.when(later, F.col("departure") + F.expr("interval 1 day")).otherwise(F.col("departure")))


def test_refresh_of_years_equals_a_full_run(spark, views, rows, tmp_path):
    changed = str(tmp_path / "raw")
    save(views, changed)
    first = published.publish(Store(spark, str(tmp_path / "store")), run_of(spark, changed))
    before = contents(first, rows)
    save(views, changed, published.BY_DEPARTURE, moved)
    run = run_of(spark, changed)
    again = published.refresh_years(first.store, run, 1996, 1998)
    full = published.publish(Store(spark, str(tmp_path / "full")), run)
    got, want = contents(again, rows), contents(full, rows)
    assert set(got) == set(published.INPUTS) and got == want
    assert got["revenue"] != before["revenue"] and contents(first, rows) == before
    assert not [f for f in again.datasets["capacity"].folders if f.endswith("=1996")]
    # Years outside are the files of the first run, and the run knows how many rows it wrote.
    for name, folder in first.datasets["capacity"].folders.items():
        assert (again.datasets["capacity"].folders.get(name) == folder) == (name.rsplit("=")[1] not in ("1996", "1997", "1998"))
    wrote = published.rows_written(again, first)
    assert wrote["capacity"] == again.read("capacity").where("departure_year between 1996 and 1998").count()
    assert wrote["passenger_sales"] == len(got["passenger_sales"])
    assert published.stale(first.store, run) == {}


def test_refresh_reads_one_years_tickets(spark, raw_root, first):
    cut = run_of(spark, raw_root).cut(1997, 1997)
    plan = published.STATES["monthly_tickets"](cut.raw["tickets"])._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(departure,1997-01-01" in pushed and "LessThan(departure,1998-01-01" in pushed
    states = {name: first.read(name) for name in published.STATES}
    for name in ("tickets_agg", "revenue", "passenger_sales"):
        assert f"{raw_root}/tickets" not in cut.built(states)[name]._jdf.queryExecution().toString()


def test_changed_dimension_rebuilds_all_years(spark, views, raw_root, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    changed = str(tmp_path / "raw")
    save(views, changed)
    before = published.publish(store, run_of(spark, changed))
    views.airplanes.withColumn("crew_members", F.col("crew_members") + 1).write.mode("overwrite").parquet(f"{changed}/airplanes")
    run = run_of(spark, changed)
    assert published.stale(store, run) == {"q3_staff_usage": ["airplanes"], "capacity": ["airplanes"]}
    again = published.refresh_years(store, run, 1997, 1997)
    assert rows(again.read("q3_staff_usage")) == rows(published.publish(Store(spark, str(tmp_path / "full")), run).read("q3_staff_usage"))
    assert again.datasets["airports"] == before.datasets["airports"] and again.datasets["q1_staff_counts"] == before.datasets["q1_staff_counts"]


def test_only_what_changed_is_built_again(spark, raw_root, first):
    run = run_of(spark, raw_root)
    store = first.store
    newest = published.publish(store, run)
    assert published.stale(store, run) == {} and published.up_to_date(store, run).number == newest.number
    for other, names in ((run_of(spark, raw_root, seats=None), {"capacity"}), (run_of(spark, raw_root, unique_crew=True), {"q2_staff_assignments"})):
        assert set(published.stale(store, other)) == names
    built = published.up_to_date(store, run_of(spark, raw_root, seats=None))
    assert built.number == newest.number + 1 and set(published.rows_written(built, newest)) == {"capacity"}


def test_a_touched_file_is_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(path)
    seen = fingerprint(spark.read.parquet(path))
    assert seen == fingerprint(spark.read.parquet(path))
    part = next(f for f in sorted(os.listdir(path)) if f.endswith(".parquet"))
    os.utime(f"{path}/{part}", (1_000_000, 1_000_000))
    touched = fingerprint(spark.read.parquet(path))
    os.remove(f"{path}/{part}")
    assert len({seen, touched, fingerprint(spark.read.parquet(path)), fingerprint(spark.read.parquet(path).select((F.col("id") + 1).alias("x")))}) == 4
    assert fingerprint(spark.createDataFrame([(1,)], "x int")) is None


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.publish(store.current(), {"x": store.write("x", spark.range(3).toDF("v"))})
    held = one.read("x")
    two = store.publish(one, {"x": store.write("x", spark.range(5).toDF("v"))})
    assert held.count() == 3 and store.version(1).read("x").count() == 3 and store.current().read("x").count() == 5
    assert [two.number, store.numbers()] == [2, [1, 2]]
    with pytest.raises(MissingInputs, match="lacks y"):
        two.require(["x", "y"])


def test_failed_run_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.publish(store.current(), {"x": store.write("x", spark.range(3).toDF("v"))})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        with_error = spark.range(5).select(F.expr("1 / (id - 3)").alias("v"))
        spark.conf.set("spark.sql.ansi.enabled", "true")
        store.write("x", with_error)
    assert store.current().number == 1 and one.read("x").count() == 3
    unused = store.unused()
    assert len(unused) == 1 and store.clean(1, older_than_ms=0) == [] and store.clean(1, older_than_ms=1 << 60) == unused
    assert store.unused() == [] and store.current().read("x").count() == 3


def test_two_runs_cannot_both_publish(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    since = store.current()
    a, b = store.write("x", spark.range(3).toDF("v")), store.write("x", spark.range(4).toDF("v"))
    store.publish(since, {"x": a})
    with pytest.raises(ConflictingRun):
        store.publish(since, {"x": b})
    assert not store.files.create("_versions/00000001.json", "other") and store.current().read("x").count() == 3
    assert not [name for name in store.files.names("_versions") if name.endswith(".tmp")]


def test_partitions_nulls_and_no_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(1, datetime(2020, 1, 1)), (2, datetime(2021, 1, 1)), (3, None)]
    frame = spark.createDataFrame(rows, "id int, departure timestamp_ntz").withColumn("y", F.year("departure"))
    whole = store.write("d", frame, "y")
    assert whole.rows == 3 and set(whole.folders) == {"y=2020", "y=2021", "y=__HIVE_DEFAULT_PARTITION__"}
    read = store.open("d", whole)
    assert read.columns == ["id", "departure", "y"] and read.where("y is null").first()["id"] == 3
    assert "PartitionFilters: [isnotnull(y" in read.where("y = 2020")._jdf.queryExecution().executedPlan().toString()
    none = store.write("d", frame.where("id > 9"), "y")
    assert store.open("d", none).count() == 0 and store.open("d", none).schema == read.schema
    assert sorted(r["id"] for r in store.open("d", whole.with_partitions(none, ["y=2020"])).collect()) == [2, 3]


def test_materialize_notices_changed_inputs(spark, tmp_path):
    source, path, built = str(tmp_path / "source"), str(tmp_path / "made"), []
    spark.range(3).write.parquet(source)

    def made(seats=None):
        table = spark.read.parquet(source)

        def build():
            built.append(1)
            return table.groupBy().count()

        return materialize(spark, path, build, inputs={"source": fingerprint(table), "seats": repr(seats)}).first()[0]

    assert [made(), made(), len(built)] == [3, 3, 1]
    spark.range(2).write.mode("append").parquet(source)
    assert [made(), made(), len(built)] == [5, 5, 2]
    assert [made("seats"), made("seats"), len(built)] == [5, 5, 3]
    unknown = materialize(spark, path, lambda: spark.range(1), inputs={"source": None})
    assert unknown.columns == ["id"] and made() == 5 and len(built) == 4
