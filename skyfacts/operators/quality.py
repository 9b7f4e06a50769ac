"""Declared constraints as checks that return the violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.functions.dates import in_years
from skyfacts.schemas import FIRST_YEAR, LAST_YEAR, TABLES, require_columns


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(df: DataFrame, columns: Sequence[str], target: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Non-null references without a target row, with the number of rows that hold them.

    References are counted per value first, so the anti join sees each once.
    """
    return _without_target(df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n_rows")), columns, target, target_columns)


def _without_target(used: DataFrame, columns: Sequence[str], target: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    known = target.select(*[F.col(t).alias(c) for c, t in zip(columns, target_columns)])
    return used.join(known, list(columns), "left_anti")


def null_counts(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls in each required column, in one pass; a column that is not there is null in every row."""
    names = list(columns if columns is not None else TABLES[table].required)
    tests = {name: F.col(name).isNull() if name in df.columns else F.lit(True) for name in names}
    return _counts(df, table, tests, "n_nulls")


def too_long(df: DataFrame, table: str, lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Rows whose text is longer than declared, per column, in one pass.

    Lengths are in UTF-8 bytes or in characters, as the table declares. For a
    column that is not there the number is null.
    """
    limits = dict(lengths or TABLES[table].lengths)
    size = F.octet_length if TABLES[table].in_bytes else F.char_length
    tests = {name: size(name) > limit if name in df.columns else None for name, limit in limits.items()}
    return _counts(df, table, tests, "n_too_long")


def _counts(df: DataFrame, table: str, tests: Mapping[str, Column | None], label: str) -> DataFrame:
    """A row per test, whether its column is there, and how many rows pass it."""
    found = [
        F.struct(
            F.lit(table).alias("table"), F.lit(name).alias("column"), F.lit(name in df.columns).alias("present"),
            (F.lit(None).cast("bigint") if test is None else F.count_if(test)).alias(label),
        )
        for name, test in tests.items()
    ]
    return df.agg(F.count("*").alias("n_rows"), F.array(*found).alias("found")).select(F.inline("found"))


def declared_length_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """too_long for every given table that declares lengths."""
    return reduce(DataFrame.unionAll, [too_long(df, name) for name, df in tables.items() if TABLES[name].lengths])


def declared_null_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """null_counts for every given table with required columns."""
    return reduce(DataFrame.unionAll, [null_counts(df, name) for name, df in tables.items() if TABLES[name].required])


def outside_years(df: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, departure: str = "departure") -> DataFrame:
    """Rows that depart outside the accepted years."""
    return df.where(~in_years(departure, first, last))


def declared_key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For each given table, its key and how many key values repeat."""
    parts = []
    for name, df in tables.items():
        for key in (TABLES[name].key, *TABLES[name].unique):
            parts.append(
                duplicate_keys(df, key).agg(
                    F.lit(name).alias("table"),
                    F.lit(", ".join(key)).alias("key"),
                    F.count("*").alias("n_duplicate_keys"),
                )
            )
    return reduce(DataFrame.unionAll, parts)


def declared_reference_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For each declared reference between given tables, missing targets and rows affected.

    A given table without the columns of a reference is an error. Where one
    reference's columns hold another's, the rows are counted by the longer one,
    whose counts are added up for the shorter: both share that shuffle.
    """

    def used(df: DataFrame, columns: Sequence[str], longest: Sequence[str]) -> DataFrame:
        counts = df.groupBy(*longest).agg(F.count("*").alias("n_rows"))
        # The null test takes in the count, so it stays above the grouping.
        rows = counts.where(F.when(F.col("n_rows") > 0, reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])))
        return rows if columns == longest else rows.groupBy(*columns).agg(F.sum("n_rows").alias("n_rows"))

    parts = []
    for name, df in tables.items():
        given = [ref for ref in TABLES[name].references if ref.table in tables]
        for ref in given:
            require_columns(df, list(ref.columns), name)
        for ref in given:
            longest = max((r.columns for r in given if set(ref.columns) <= set(r.columns)), key=len)
            parts.append(
                _without_target(used(df, ref.columns, longest), ref.columns, tables[ref.table], ref.target).agg(
                    F.lit(name).alias("table"),
                    F.lit(", ".join(ref.columns)).alias("columns"),
                    F.lit(ref.table).alias("target"),
                    F.count("*").alias("n_missing"),
                    F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
                )
            )
    return reduce(DataFrame.unionAll, parts)
