"""What the text operators share: the folder that all machines see, settled tables, folds and Arrow batches."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 1000
#: Rows that Spark's Parquet reader decodes at once: its buffers hold that many texts, and are made anew as they grow.
READ_ROWS = 256
#: Parts in which a sample is drawn.
PARTS = 32


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    That is `spark.checkpoint.dir`; where it is unset, a folder of the
    warehouse, which Spark itself shares between all machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """The frame, written once as a Parquet table in the shared folder and read again.

    This cuts the lineage: a lost executor later costs a read, not the work
    before. Spark's commit protocol keeps each row exactly once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + quote(uri[5:].lstrip("/"))
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Arrow and Parquet batches of few rows: one text can be megabytes long, and the size of a batch with lists is summed up for each row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark


def draw(rows: DataFrame, share: str, most: int, most_bytes: int, short: int) -> list[tuple]:
    """A bounded sample of rows (key, share, size): the (key, share) of those drawn, in the order of the draw.

    Each value of `share` gets `most` rows and `most_bytes` bytes at most, but
    one row always: those of up to `short` bytes in the order of their key, which
    should be a hash, then longer ones from the shortest up. So no kind of rows
    is left out for its length, and a long text is read where a kind has too few
    short ones. At most `most` rows for each kind reach the driver.
    """
    long = F.when(F.col("size") > short, F.col("size")).otherwise(0)
    # In parts of the key first, so that the last task gets `most` rows of each part, whatever the table.
    part = F.pmod("key", F.lit(PARTS))
    early = rows.withColumn("early", F.row_number().over(Window.partitionBy(share, part).orderBy(long, "key"))).where(F.col("early") <= most)
    order = Window.partitionBy(share).orderBy(long, "key")
    first = early.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("upto", upto).where((F.col("upto") <= most_bytes) | (F.col("nth") == 1))
    return [(r["key"], r[share]) for r in kept.orderBy(share, "nth").select("key", share).collect()]


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def input_mb(df: DataFrame, text_col: str = "text") -> float:
    """Size of a frame in MB: Catalyst's estimate for files, else the measured bytes of its texts."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= 1 << 60:  # no statistics
        estimate = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 64)).first()[0] or 0
    return estimate / 1e6
