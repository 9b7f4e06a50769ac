"""Session set-up: the SQL settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Run-time SQL settings. Skewed joins are split by adaptive execution; the
# force flag keeps the split even where a later aggregation could have reused
# the join's partitioning, because one extra shuffle is cheaper than one task
# that holds a third of the rows.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Settings of reports: a task of a scan, join or grouping gets about as much to hold, whatever the input.
REPORT_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of the largest input table for each partition that a shuffle starts with; adaptive execution merges small ones.
BYTES_PER_PARTITION = 2 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def tune_reports(spark: SparkSession, input_bytes: int) -> None:
    """Bound what one task of a report holds: shuffles get more partitions as the largest table grows."""
    for key, value in REPORT_SETTINGS.items():
        spark.conf.set(key, value)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, str(max(least, input_bytes // BYTES_PER_PARTITION)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skyfacts") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

