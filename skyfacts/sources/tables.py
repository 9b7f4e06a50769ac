"""Reading tables: Parquet, catalog tables, SQL text and JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfacts.functions.columns import normalize_names


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet dataset; a given schema saves the footer read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_table(
    source: DataFrame, columns: Sequence[str] | None = None, where: str | None = None
) -> DataFrame:
    """Column subset and SQL predicate over a table.

    Names are matched without regard to case. The filter runs on the whole
    table's columns and Catalyst pushes it, and the projection, to the scan.
    """
    filtered = source.where(where) if where else source
    if not columns:
        return normalize_names(filtered)
    known = {name.strip().lower(): name for name in source.columns}
    wanted = [name.strip().lower() for name in columns]
    missing = [name for name in wanted if name not in known]
    if missing:
        raise ValueError(f"no such column(s): {', '.join(missing)}")
    return filtered.select(*[F.col(quoted(known[name])).alias(name) for name in wanted])


def quoted(identifier: str) -> str:
    """An identifier in backticks, safe for any name."""
    return "`" + identifier.replace("`", "``") + "`"


def read_sql(
    spark: SparkSession, text: str, params: Mapping[str, object] | None = None, **frames: DataFrame
) -> DataFrame:
    """Spark SQL with bound parameters and normalised column names.

    Parameters are written :name; a frame given by name is written {name}.
    """
    return normalize_names(spark.sql(text, args=dict(params) if params else None, **frames))


def preview(source: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of a table, in no particular order."""
    return normalize_names(source.limit(int(rows)))


def count_rows(source: DataFrame) -> DataFrame:
    return source.agg(F.count("*").alias("n_rows"))


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower_bound: str | int | None = None,
    upper_bound: str | int | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options for Spark's JDBC source.

    A query becomes a derived table so that it, too, can be read in parallel
    slices of a partition column. Credentials come from the caller.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {
        "url": url,
        "dbtable": table if table is not None else f"({query}) q",
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
        "pushDownAggregate": "true",
    }
    slices = (partition_column, lower_bound, upper_bound, partitions)
    if any(part is not None for part in slices):
        if any(part is None for part in slices):
            raise ValueError("a parallel read needs column, both bounds and the number of partitions")
        options |= {
            "partitionColumn": str(partition_column),
            "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound),
            "numPartitions": str(partitions),
        }
    return options | dict(properties or {})


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A warehouse table or query with normalised column names."""
    return normalize_names(spark.read.format("jdbc").options(**options).load())
