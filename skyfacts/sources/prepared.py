"""Prepared datasets on shared storage: build when missing, check, extract, cache."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skyfacts.functions.columns import standardize_names
from skyfacts.sources.files import Files
from skyfacts.sources.sinks import write_parquet
from skyfacts.sources.tables import read_table

# Columns taken from each raw table; None takes all of them.
RAW_EXTRACTS: dict[str, tuple[Sequence[str] | None, str | None]] = {
    "staff": (None, None),
    "flight_crew": (None, None),
    "flights": (
        ("flight_id", "route_code", "departure", "arrival", "airplane",
         "price_economy", "price_premium", "price_business"),
        None,
    ),
    "routes": (("route_code", "origin", "destination", "flight_minutes", "distance"), None),
    "airplanes": (
        ("aircraft_registration", "model", "crew_members",
         "seats_economy", "seats_premium", "seats_business"),
        None,
    ),
    "airports": (("iata_code", "city", "country", "continent"), None),
}

#: File beside a dataset with the fingerprints of what it was built from.
INPUTS = "_inputs/told.json"
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class UnfinishedDataset(RuntimeError):
    """A dataset whose write did not finish, or that was written elsewhere."""


class MissingInputs(FileNotFoundError):
    """Prepared datasets that a report needs are not there."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable Parquet dataset is at the path."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return False
        raise
    return True


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the write of the dataset was committed as a whole."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None] = write_parquet,
    inputs: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Read the dataset; build and write it first when it is not there, or when it is out of date.

    `inputs` are fingerprints (see `files.fingerprints`) and parameters; with
    them, a dataset that was built from others, or from unknown ones, is built
    again. Data without the mark of a finished write is neither trusted nor
    replaced.
    """
    files = Files(spark, path)
    told = None if inputs is None or None in inputs.values() else json.dumps(dict(inputs), sort_keys=True)
    if not finished(spark, path):
        if exists(spark, path):
            raise UnfinishedDataset(f"{path} holds data but no _SUCCESS mark; check and remove it")
        write(build(), path)
    elif inputs is not None and (told is None or not files.exists(INPUTS) or files.text(INPUTS) != told):
        files.delete(INPUTS)  # an overwrite that fails leaves no mark that fits
        write(build(), path)
    else:
        return spark.read.parquet(path)
    if told:
        files.create(INPUTS, told)
    return spark.read.parquet(path)


def require_inputs(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """All named datasets under a folder, or one error that lists the absent ones."""
    paths = {name: f"{root}/{name}" for name in names}
    absent = [name for name, path in paths.items() if not finished(spark, path)]
    if absent:
        raise MissingInputs(f"run the preparation first; missing or unfinished under {root}: {', '.join(absent)}")
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def extract(
    tables: Mapping[str, DataFrame],
    root: str,
    manifest: Mapping[str, tuple[Sequence[str] | None, str | None]] = RAW_EXTRACTS,
) -> list[str]:
    """Write the manifest's columns and rows of each table as Parquet; the paths written."""
    paths = []
    for name in manifest:
        path = f"{root}/{name}"
        write_parquet(extracted(tables, name, manifest), path)
        paths.append(path)
    return paths


def extracted(
    tables: Mapping[str, DataFrame],
    name: str,
    manifest: Mapping[str, tuple[Sequence[str] | None, str | None]] = RAW_EXTRACTS,
) -> DataFrame:
    """The manifest's columns and rows of one table, under standard names."""
    columns, where = manifest[name]
    return standardize_names(read_table(tables[name], columns, where))


def clean(table: DataFrame) -> DataFrame:
    """A whole table under standard names."""
    return standardize_names(table)


def export_clean(table: DataFrame, path: str) -> None:
    """A whole table with standardised names as Parquet."""
    write_parquet(clean(table), path)


def shared(df: DataFrame) -> DataFrame:
    """Keep a frame that several reports read; blocks lost with an executor are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
