"""The airline tables as views over the TPC-H-like test tables.

The same mapping exists twice on purpose: here with the DataFrame API, and in
oracle_views as SQL text for DuckDB, so that each checks the other.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.schemas import FLIGHT_KEY

# Columns and types of the test tables that the views use.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz""",
}

LEGS = 7


def padded(key: str) -> Column:
    """A key in at least six digits; longer keys keep all of theirs."""
    text = F.col(key).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def flight_id() -> Column:
    digit = F.col("l_partkey") % 10
    parts = [F.col("l_suppkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), digit]
    return F.concat(F.lit("F"), *[part.cast("string") for part in parts])


def route_code() -> Column:
    return F.concat(F.lit("R"), padded("l_suppkey"), F.lit("-"), F.col("l_linenumber").cast("string"))


def shifted(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


class AirlineViews:
    """Airline tables derived from one folder of test tables; built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    @cached_property
    def input_bytes(self) -> int:
        """Size of the largest table's files, from Spark's own listing of them."""
        return int(str(self.source("lineitem")._jdf.queryExecution().analyzed().stats().sizeInBytes()))

    @cached_property
    def _places(self) -> DataFrame:
        nation, region = self.source("nation"), self.source("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def airports(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.source("supplier")
            .where(key % 20 != 7)
            .join(self._places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("A"), padded("s_suppkey")).alias("iata_code"),
                F.col("s_name").alias("airport"),
                F.concat(F.lit("CITY "), key.cast("string")).alias("city"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("continent"),
                F.concat(F.lit("UTC+"), (key % 12).cast("string")).alias("timezone"),
                (key * 37 % 180 - 90).cast("double").alias("latitude"),
                (key * 53 % 360 - 180).cast("double").alias("longitude"),
                (key % 5000 / 100).cast("decimal(5,2)").alias("airport_tax"),
            )
        )

    @cached_property
    def routes(self) -> DataFrame:
        supplier = self.source("supplier").select("s_suppkey")
        total = supplier.agg(F.count("*")).scalar()
        legs = supplier.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(LEGS))).alias("i"))
        key, i = F.col("s_suppkey"), F.col("i")
        measured = ~((key % 10 == 3) & (i == 7))
        spread = key * 131 + i * 977
        legs = legs.withColumn("_to", (key + i) % total)
        own = F.concat(F.lit("R"), padded("s_suppkey"), F.lit("-"))
        return legs.select(
            F.concat(own, i.cast("string")).alias("route_code"),
            F.concat(F.lit("A"), padded("s_suppkey")).alias("origin"),
            F.concat(F.lit("A"), padded("_to")).alias("destination"),
            F.when(key % 50 == 11, F.lit("R-NONE")).otherwise(F.concat(own, F.lit("1"))).alias("parent_route"),
            i.cast("smallint").alias("leg_number"),
            F.when(measured, spread % 9000 + 300).cast("int").alias("distance"),
            F.when(measured, spread % 600 + 40).cast("smallint").alias("flight_minutes"),
        )

    @cached_property
    def airplanes(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.source("part").select(
            F.concat(F.lit("P"), padded("p_partkey")).alias("aircraft_registration"),
            F.col("p_brand").alias("model"),
            F.lit(2).cast("smallint").alias("seats_business"),
            F.lit(4).cast("smallint").alias("seats_premium"),
            (size + 14).cast("smallint").alias("seats_economy"),
            (size % 6 + 1).cast("smallint").alias("crew_members"),
            shifted("1990-01-01", key * 13 % 9000).alias("build_date"),
            (size * 20 + 300).cast("smallint").alias("fuel_gallons_hour"),
            shifted("2000-01-01", key * 7 % 700).alias("maintenance_last_acheck"),
            shifted("1999-01-01", key * 11 % 900).alias("maintenance_last_bcheck"),
            (key % 5000).cast("smallint").alias("maintenance_takeoffs"),
            (key * 7 % 20000).cast("int").alias("maintenance_flight_hours"),
            (key * 97 % 5000000).cast("int").alias("total_flight_distance"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        """Tickets without the passenger, straight from one scan."""
        return self._tickets(self.source("lineitem"), [])

    @cached_property
    def passenger_tickets(self) -> DataFrame:
        """Tickets with the passenger, who is looked up by order."""
        return self._tickets(self._booked, [F.col("o_custkey").alias("passenger_id")])

    @cached_property
    def _booked(self) -> DataFrame:
        lines, orders = self.source("lineitem"), self.source("orders")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    @staticmethod
    def _tickets(lines: DataFrame, extra: list[Column]) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        tax, discount = F.col("l_tax").cast("decimal(4,2)"), F.col("l_discount").cast("decimal(4,2)")
        # At most 99.99, so that the product has 17 digits and fits a long.
        gross = (F.lit(1).cast("decimal(1,0)") + tax + discount).cast("decimal(4,2)")
        cabin = F.col("l_returnflag")
        return lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"),
            *extra,
            flight_id().alias("flight_id"),
            route_code().alias("route_code"),
            F.col("l_shipdate").alias("departure"),
            F.when(cabin == "N", "E").when(cabin == "A", "P").when(cabin == "R", "B").alias("class"),
            F.col("l_partkey").alias("plane_number"),
            F.col("l_linenumber").cast("smallint").alias("leg"),
            F.col("l_quantity").cast("int").alias("seats"),
            price.alias("price"),
            (price * tax).alias("airport_tax"),
            (price * discount).alias("local_tax"),
            (price * gross).alias("total_amount"),
        )

    @cached_property
    def flights(self) -> DataFrame:
        """One row per flight; the lowest aircraft number flies it, unless it is unknown.

        The number is aggregated, not the text key: a minimum of text would
        force a sort of all tickets before the partial aggregation. Unsold flights are
        dealt by the key too, so that a join by flight does not shuffle the sold ones again.
        """
        flown = self.tickets.groupBy("flight_id", "route_code", "departure").agg(
            F.min("plane_number").alias("plane_number"),
            F.max("price").alias("price_economy"),
            F.min("leg").alias("flight_leg"),
        )
        plane = F.when(F.col("plane_number") % 97 == 5, "P-NONE").otherwise(F.concat(F.lit("P"), padded("plane_number")))
        return flown.withColumn("airplane", plane).drop("plane_number").unionByName(self._unsold.repartition(*FLIGHT_KEY))

    @property
    def _unsold(self) -> DataFrame:
        """Two flights per supplier that sold nothing; some have an unknown aircraft."""
        key, day = F.col("s_suppkey"), F.col("day")
        legs = self.source("supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("day"))
        number = F.lpad((key % 100 + 1).cast("string"), F.lit(6), F.lit("0"))
        return legs.select(
            F.concat(F.lit("E"), key.cast("string")).alias("flight_id"),
            F.concat(F.lit("R"), padded("s_suppkey"), F.lit("-1")).alias("route_code"),
            (F.lit(datetime(1998, 2, 27)).cast("timestamp_ntz") + F.make_dt_interval((key % 40 + day).cast("int"))).alias("departure"),
            F.lit(None).cast("decimal(12,2)").alias("price_economy"),
            F.lit(1).cast("smallint").alias("flight_leg"),
            F.when(key % 9 == 4, "P-NONE").otherwise(F.concat(F.lit("P"), number)).alias("airplane"),
        )

    @cached_property
    def staff(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.source("customer")
            .where(key % 97 != 13)
            .select(
                key.alias("empno"),
                F.col("c_name").alias("firstnme"),
                F.concat(F.lit("L"), (key % 50).cast("string")).alias("lastname"),
                F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
                shifted("1990-01-01", key % 3000).alias("hiredate"),
                F.when(key % 10 == 9, "GROUND").otherwise(F.col("c_mktsegment")).alias("department"),
            )
        )

    @cached_property
    def flight_crew(self) -> DataFrame:
        """Dealt by flight while a booking is still one row: neither the distinct rows nor counts and joins by flight shuffle the crew again.

        Flights without an id are told apart by the numbers that theirs would be made of.
        """
        total = self.source("customer").agg(F.count("*")).scalar()
        need = F.col("l_quantity").cast("int") % 6
        member = (F.col("o_custkey") + F.col("i") * 37) % total
        numbers = F.struct("l_suppkey", "l_linenumber", (F.col("l_partkey") % 10).alias("digit"))
        key = [flight_id().alias("flight_id"), route_code().alias("route_code"), F.col("l_shipdate").alias("departure")]
        return (
            self._booked.where(need > 0)
            .select("o_custkey", need.alias("need"), *key, F.when(flight_id().isNull(), F.to_json(numbers)).alias("unnamed"))
            .repartition(*FLIGHT_KEY)
            .select("o_custkey", *FLIGHT_KEY, "unnamed", F.explode(F.sequence(F.lit(0), F.col("need") - 1)).alias("i"))
            .select(member.alias("empno"), *FLIGHT_KEY, "unnamed")
            .where(F.col("empno") % 10 != 9)
            .distinct()
            .drop("unnamed")
        )

    @cached_property
    def passengers(self) -> DataFrame:
        nation = self.source("nation")
        key = F.col("c_custkey")
        return (
            self.source("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("id"),
                F.col("c_name").alias("firstnme"),
                F.col("n_name").alias("country"),
                F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("vipcard"),
                shifted("1940-01-01", key * 31 % 25000).alias("birth_date"),
            )
        )
