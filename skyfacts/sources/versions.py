"""Datasets published as versions.

A run writes files of its own and changes none. A small manifest then names, for
every dataset, the folders that make it up: those of this run, and for years or
months that it left alone those of earlier runs. Publishing is the creation of
the next manifest, which is there as a whole or not at all. A reader that has
opened a version keeps it; a run that fails leaves the current one as it is; of
two runs that started from the same version only the first can publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyfacts.sources.files import Files
from skyfacts.sources.prepared import MissingInputs

MANIFESTS, RUN = "_versions", "run"


class ConflictingRun(RuntimeError):
    """Another run has published since this one began."""


@dataclass(frozen=True)
class Dataset:
    """What a manifest says of one dataset.

    folders: by partition (`year=2024`; "" for a dataset without), relative to the root.
    inputs: fingerprint of each input and parameter it was built from; None where that is unknown.
    rows: rows that the last run wrote, which are all rows unless it replaced partitions only.
    """

    schema: str
    partition: str | None
    folders: Mapping[str, str]
    inputs: Mapping[str, str | None] = field(default_factory=dict)
    rows: int = 0

    def only(self, names: Iterable[str]) -> Dataset:
        """This dataset with some of its partitions."""
        names = set(names)
        return replace(self, folders={name: folder for name, folder in self.folders.items() if name in names})

    def with_partitions(self, new: Dataset, names: Iterable[str]) -> Dataset:
        """This dataset with the named partitions as they are in another: replaced, added, or gone."""
        names = set(names)
        kept = {name: folder for name, folder in self.folders.items() if name not in names}
        return replace(new, folders=kept | {name: folder for name, folder in new.folders.items() if name in names})


@dataclass(frozen=True)
class Version:
    """A published state of all datasets; what it reads does not change."""

    store: Store
    number: int
    datasets: Mapping[str, Dataset]

    def read(self, name: str) -> DataFrame:
        if name not in self.datasets:
            raise MissingInputs(f"version {self.number} under {self.store.root} has no dataset {name}")
        return self.store.open(name, self.datasets[name])

    def require(self, names: Iterable[str]) -> dict[str, DataFrame]:
        """All named datasets, or one error that lists the absent ones."""
        names = list(names)
        absent = [name for name in names if name not in self.datasets]
        if absent:
            raise MissingInputs(f"version {self.number} under {self.store.root} lacks {', '.join(absent)}")
        return {name: self.read(name) for name in names}

    def changed(self, name: str, inputs: Mapping[str, str | None]) -> list[str]:
        """Inputs of a dataset that are not as they were, or not known to be; all if it is not there."""
        if name not in self.datasets:
            return sorted(inputs)
        was = self.datasets[name].inputs
        return sorted(key for key in {*inputs, *was} if inputs.get(key) is None or inputs[key] != was.get(key))


class Store:
    """Versioned datasets under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def numbers(self) -> list[int]:
        names = (name.removesuffix(".json") for name in self.files.names(MANIFESTS) if name.endswith(".json"))
        return sorted(int(name) for name in names if name.isdigit())

    def version(self, number: int) -> Version:
        """A version by number; 0 is the state before the first run."""
        if number == 0:
            return Version(self, 0, {})
        told = json.loads(self.files.text(f"{MANIFESTS}/{number:08d}.json"))
        return Version(self, number, {name: Dataset(**each) for name, each in told["datasets"].items()})

    def current(self) -> Version:
        return self.version(max(self.numbers(), default=0))

    def write(self, name: str, df: DataFrame, partition: str | None = None, inputs: Mapping[str, str | None] | None = None) -> Dataset:
        """Write a frame to a folder of its own; nothing sees it until it is published.

        Rows are counted as they are written, after the last shuffle. The
        rebalance hint gives each partition a few files of even size and splits
        one that is far larger than the others.
        """
        own = f"{name}/{RUN}=r{uuid.uuid4().hex}"
        seen = Observation()
        laid = (df.hint("rebalance", F.col(partition)) if partition else df).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = laid.write.mode("errorifexists")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.root}/{own}")
        names = [n for n in self.files.folders(own) if n.startswith(f"{partition}=")] if partition else [""]
        columns = [f for f in df.schema.fields if f.name != partition] + [f for f in df.schema.fields if f.name == partition]
        return Dataset(
            StructType(columns).json(), partition, {n: f"{own}/{n}".rstrip("/") for n in names}, dict(inputs or {}), seen.get.get("rows", 0)
        )

    def open(self, name: str, dataset: Dataset) -> DataFrame:
        """A written dataset, published or not; filters on its partition column skip folders."""
        schema = StructType.fromJson(json.loads(dataset.schema))
        if not dataset.folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        found = reader.parquet(*[f"{self.root}/{folder}" for folder in dataset.folders.values()])
        return found.select(*[f"`{column}`" for column in schema.names])

    def publish(self, since: Version, datasets: Mapping[str, Dataset]) -> Version:
        """The next version: these datasets, and all others as they were in `since`."""
        number, merged = since.number + 1, {**since.datasets, **datasets}
        told = json.dumps({"version": number, "datasets": {name: asdict(each) for name, each in merged.items()}}, indent=1)
        if self.numbers()[-1:] not in ([], [since.number]) or not self.files.create(f"{MANIFESTS}/{number:08d}.json", told):
            raise ConflictingRun(f"version {number} under {self.root} was published by another run; begin again from it")
        return Version(self, number, merged)

    def unused(self, keep: int = 1) -> list[str]:
        """Folders of runs that none of the newest `keep` versions names: of older versions, of failed runs, or of one still at work."""
        named = {folder for number in self.numbers()[-keep:] for each in self.version(number).datasets.values() for folder in each.folders.values()}
        held = {"/".join(folder.split("/")[:2]) for folder in named}
        runs = [f"{name}/{run}" for name in self.files.folders("") if name != MANIFESTS for run in self.files.folders(name) if run.startswith(f"{RUN}=")]
        return [run for run in runs if run not in held]

    def clean(self, keep: int, older_than_ms: int) -> list[str]:
        """Delete unused folders last changed before a time (milliseconds since 1970); those deleted. Readers of older versions lose them."""
        return [run for run in self.unused(keep) if self.files.changed_ms(run) < older_than_ms and self.files.delete(run)]
