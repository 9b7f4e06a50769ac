"""Files on the storage that Spark uses: the few operations beside its readers and writers, and fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file operations that Spark's readers and writers do not cover."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark._jvm.org.apache.hadoop.fs
        self.root = root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, relative: str):
        return self._jvm.Path(f"{self.root}/{relative}" if relative else self.root)

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self.path(relative))

    def names(self, relative: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        if not self.exists(relative):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self.path(relative)))

    def folders(self, relative: str) -> list[str]:
        if not self.exists(relative):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(relative)) if s.isDirectory())

    def changed_ms(self, relative: str) -> int:
        return self._fs.getFileStatus(self.path(relative)).getModificationTime()

    def text(self, relative: str) -> str:
        return self._spark.read.text(f"{self.root}/{relative}", wholetext=True).first()[0]

    def create(self, relative: str, text: str) -> bool:
        """Write a new file in one step; False if there is one by that name."""
        draft = self.path(f"{relative}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.FileContext.getFileContext(draft.toUri(), self._conf)
        rename = self._jvm.Options.Rename
        try:  # not replacing is part of this call, so two runs cannot both succeed
            context.rename(draft, self.path(relative), self._spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if self.exists(relative):
                return False
            raise error
        return True

    def delete(self, relative: str) -> bool:
        return self._fs.delete(self.path(relative), True)


def fingerprint(df: DataFrame) -> str | None:
    """What tells one state of a frame's files from another: their names, lengths and times, and the frame's columns.

    Listed and added up by Spark; the order of files does not matter. None for a
    frame that does not come from files.
    """
    folders = sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()})
    if not folders:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    n, size, mixed = listed.agg(F.count("*"), F.sum("length"), F.bit_xor(each)).first()
    columns = F.xxhash64(F.lit(df.schema.simpleString()))
    return f"{n}-{size}-{mixed}-{df.sparkSession.range(1).select(columns).first()[0]}"


def fingerprints(frames: Mapping[str, DataFrame]) -> dict[str, str | None]:
    return {name: fingerprint(df) for name, df in frames.items()}
