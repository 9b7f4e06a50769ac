"""What the session and the catalog hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas that belong to the warehouse itself.
SYSTEM_SCHEMA_PREFIX = "SYS"
SYSTEM_SCHEMAS = ("NULLID", "SQLJ")
TABLE_TYPES = ("T", "V")


def session_context(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "select current_catalog() as current_server, current_schema() as current_schema,"
        " current_user() as current_user"
    )


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of every schema in the session's catalog (names only)."""
    rows = [
        (db.name, table.name, "V" if table.tableType in ("VIEW", "TEMPORARY") else "T")
        for db in spark.catalog.listDatabases()
        for table in spark.catalog.listTables(db.name)
    ]
    listed = spark.createDataFrame(rows, "schema_name string, table_name string, table_type string")
    return listed.distinct().orderBy("schema_name", "table_name")


def user_tables(dictionary: DataFrame) -> DataFrame:
    """User tables and views from a warehouse dictionary (tabschema, tabname, type)."""
    schema, name = F.rtrim("tabschema"), F.rtrim("tabname")
    return (
        dictionary.where(
            F.col("type").isin(*TABLE_TYPES)
            & ~F.col("tabschema").like(f"{SYSTEM_SCHEMA_PREFIX}%")
            & ~schema.isin(*SYSTEM_SCHEMAS)
        )
        .select(schema.alias("schema_name"), name.alias("table_name"), F.col("type").alias("table_type"))
        .orderBy("schema_name", "table_name")
    )


def objects_by_schema(tables: DataFrame) -> DataFrame:
    """Number of objects per schema and type."""
    return (
        tables.groupBy("schema_name", "table_type")
        .agg(F.count("*").alias("n_objects"))
        .orderBy("schema_name", "table_type")
    )
