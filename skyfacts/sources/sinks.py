"""Writing results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.sources.files import Files


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def with_year(df: DataFrame, year: str, departure: str | None = None) -> DataFrame:
    """The frame with the column of its year folders."""
    return df.withColumn(year, F.year(departure)) if departure else df


def write_by_year(
    df: DataFrame, path: str, year: str, departure: str | None = None, mode: str = "overwrite", refresh: bool = False,
    years: Iterable[int] = (),
) -> None:
    """Parquet in one folder per year, so year filters skip whole folders.

    A refresh replaces the folders of the years in the frame and leaves the
    others; `years` are those that it is meant for, and lose their folder if the
    frame has none of their rows.

    The rebalance hint gives each year a few files of even size and, unlike a
    plain repartition, splits a year that is far larger than the others.
    """
    writer = with_year(df, year, departure).hint("rebalance", F.col(year)).write.mode(mode).partitionBy(year)
    files = Files(df.sparkSession, path)
    asked = [f"{year}={value}" for value in years] if refresh else []
    before = {folder: set(files.names(folder)) for folder in asked}
    writer.option("partitionOverwriteMode", "dynamic" if refresh else "static").parquet(path)
    for folder in asked:
        # The write replaced every file of a year that it had rows of; a year with its old files had none.
        if before[folder] and before[folder] == set(files.names(folder)):
            files.delete(folder)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line and no index column."""
    df.write.mode(mode).option("header", True).csv(path)
