"""Exact distinct counts that add up: values numbered once, and bitmaps of their numbers.

A value is (part, nth): the hash deals values into parts, and each part numbers
its own from 1, so no task sees all of them. A set of values is one bitmap per part and
page of 32,768 numbers. Sets are united by `bitmap_or_agg`, which merges
map-side, so distinct values of any period come from the sets of its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the dictionary; a bitmap takes 4 KB before compression, so a part should have thousands of values.
PARTS = 4
#: Bytes of the table that values come from for each further part: a part is sorted in one task.
BYTES_PER_PART = 64 << 20
#: The columns that tell the bitmaps of one set apart.
PLACE = ("part", "page")


def parts_for(input_bytes: int) -> int:
    """Parts of a dictionary of values from a table of so many bytes, so that a part does not grow with it."""
    return max(PARTS, input_bytes // BYTES_PER_PART)


def dictionary(values: DataFrame, column: str, known: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """(value, part, nth) for each distinct value, null too.

    With `known`, an earlier dictionary of as many parts, its values keep their
    numbers and new ones follow, so that sets made with it stay valid.
    """
    distinct = values.select(F.col(column).alias("value")).distinct()
    if known is not None:
        old = known.select(F.col("value").alias("_old"))
        distinct = distinct.join(old, F.col("value").eqNullSafe(F.col("_old")), "left_anti")
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value")).cast("bigint")
    fresh = dealt.select("value", "part", nth.alias("nth"))
    if known is None:
        return fresh
    used = known.groupBy("part").agg(F.max("nth").alias("used"))
    after = F.col("nth") + F.coalesce("used", F.lit(0))
    return known.select("value", "part", "nth").unionByName(fresh.join(used, "part", "left").select("value", "part", after.alias("nth")))


def numbered(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The frame with `part`, `page` and `bit` of a column's values; all must be in the dictionary."""
    places = numbers.select(
        F.col("value").alias("_value"), "part",
        F.bitmap_bucket_number("nth").alias("page"), F.bitmap_bit_position("nth").alias("bit"),
    )
    return df.join(places, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def set_of(bit: str = "bit") -> Column:
    """Aggregate: the bitmap of a group's bits. Group by PLACE among others."""
    return F.bitmap_construct_agg(bit)


def size_of_union(bits: str = "bits") -> Column:
    """Aggregate: how many values the group's bitmaps hold together. Group by PLACE among others, then add up."""
    return F.bitmap_count(F.bitmap_or_agg(bits))
