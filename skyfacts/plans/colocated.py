"""Tables bucketed by flight, so that facts of flights join without a shuffle.

Flights, crew and ticket counts lie in as many buckets of the flight key, and
the plain functions of `facts` find them in place: `staff_usage`, `capacity` and
`crew_master` over these tables exchange nothing below the flight join. Tickets
are counted per flight first, so a flight that a third of all tickets name is
one row. Crew rows stay single; where one bucket would hold far more than the
others, as a hot flight makes it, the crew table is saved without buckets, and
its joins shuffle, where adaptive execution splits a skewed key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.plans import facts

BUCKETS = 64
#: A bucket may hold so many times the mean bucket's rows.
MOST_SKEW = 4.0
#: Tables by the name of their input.
NAMES = {"flights": "flights_by_key", "flight_crew": "crew_by_key", "tickets": "ticket_counts_by_key"}
SOLD = "tickets_sold"


def ticket_counts(tickets: DataFrame, seats: str | None = None) -> DataFrame:
    """Seats sold per flight: rows, or the sum of a column of seats. Add these up with `facts.capacity(…, seats=SOLD)`."""
    sold = F.sum(seats) if seats else F.count("*")
    return tickets.groupBy(*facts.KEY).agg(sold.cast("bigint").alias(SOLD))


def bucket_sizes(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_rows) of every bucket that the frame has rows for, by the hash that Spark's buckets use."""
    return df.groupBy(F.pmod(F.hash(*facts.KEY), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n_rows"))


def skew(df: DataFrame, buckets: int = BUCKETS) -> float:
    """Rows of the largest bucket over those of the mean bucket; 0 for an empty frame."""
    found = bucket_sizes(df, buckets).agg(F.max("n_rows").alias("most"), F.sum("n_rows").alias("rows")).first()
    return found["most"] * buckets / found["rows"] if found["rows"] else 0.0


def colocate(
    raw: Mapping[str, DataFrame], database: str = "default", *,
    seats: str | None = None, buckets: int = BUCKETS, most_skew: float = MOST_SKEW,
) -> dict[str, float]:
    """Save the three tables in a database, replacing those that are there; returns the skew of each.

    The rebalance hint sends a bucket to one task and splits one that is too
    large, so a bucket is a few files.
    """
    made = {"flights": raw["flights"], "flight_crew": raw["flight_crew"], "tickets": ticket_counts(raw["tickets"], seats)}
    found = {}
    for name, df in made.items():
        found[name] = skew(df, buckets)
        writer = df.hint("rebalance", buckets, *[F.col(key) for key in facts.KEY]).write.mode("overwrite").format("parquet")
        if found[name] <= most_skew:
            writer = writer.bucketBy(buckets, *facts.KEY).sortBy(*facts.KEY)
        writer.saveAsTable(f"{database}.{NAMES[name]}")
    return found


def read(spark: SparkSession, database: str = "default") -> dict[str, DataFrame]:
    """The saved tables by the name of their input; `tickets` are the counts per flight."""
    return {name: spark.table(f"{database}.{table}") for name, table in NAMES.items()}
