"""Table profiles and small generic summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfacts.functions.columns import numeric_columns
from skyfacts.functions.dates import add_date_parts
from skyfacts.functions.ranks import above, below, counted_values_at_ranks, nearest


#: Binary logarithm of a distinct-value sketch's buckets.
SKETCH_BITS = 14


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, nulls, distinct values and null rate per column, highest rate first.

    Rows and nulls come from one pass. Each column's distinct values are counted
    on their own: over Parquet a pass reads just that column, equal values merge
    before the shuffle, and a left join that adds only other columns drops out.
    Several distinct counts in one aggregate would copy every row once per column
    instead. With `approx`, distinct values are estimated by sketches, all in one scan.
    """
    if approx:
        return profile_of_states(profile_states(df))

    none = F.lit(0).cast("bigint")

    def label(name: str, kind: str) -> list[Column]:
        return [F.lit(name).alias("column"), F.lit(kind).alias("dtype")]

    def unique(name: str, kind: str) -> DataFrame:
        values = df.select(F.col(f"`{name}`")).distinct()
        return values.agg(*label(name, kind), none.alias("nulls"), F.count("*").alias("n_unique"), none.alias("rows"))

    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    found = [
        F.struct(*label(*each), F.count_if(F.col(f"`{each[0]}`").isNull()).alias("nulls"), none.alias("n_unique"), F.count("*").alias("rows"))
        for each in fields
    ]
    basic = df.agg(F.array(*found).alias("found")).select(F.inline("found"))
    sums = [F.coalesce(F.sum(n), none).alias(n) for n in ("nulls", "n_unique", "rows")]
    rate = F.col("nulls") / F.greatest(F.col("rows"), F.lit(1))
    return (
        reduce(DataFrame.unionAll, [basic, *(unique(*each) for each in fields)])
        .groupBy("column", "dtype")
        .agg(*sums)
        .select("column", "dtype", "nulls", "n_unique", rate.alias("null_rate"))
        .orderBy(F.desc("null_rate"), "column")
    )


def _sketched(df: DataFrame) -> list[tuple[str, str, Column]]:
    """Name, type and sketchable value of each column; columns of nested types have their text counted."""
    found = []
    for f in df.schema.fields:
        value, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            value = value + F.lit(0.0)  # 0 and -0 are one value
        if not isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
            value = value.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(value))
        found.append((f.name, kind.simpleString(), value))
    return found


def profile_states(df: DataFrame, *keys: str | Column, log2_buckets: int = SKETCH_BITS) -> DataFrame:
    """One scan for all columns: rows, nulls and a sketch of the distinct values per column, a row per key.

    The states of different days or files add up in `profile_of_states`, so a
    table that grows is profiled by its new part.
    """

    def one(name: str, kind: str, value: Column) -> Column:
        column = F.col(f"`{name}`")
        sketch = F.hll_sketch_agg(value, F.lit(log2_buckets))
        return F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.count("*").alias("rows"),
            F.count_if(column.isNull()).alias("nulls"), sketch.alias("sketch"),
        )

    return df.groupBy(*keys).agg(F.array(*[one(*each) for each in _sketched(df)]).alias("columns"))


def profile_of_states(states: DataFrame) -> DataFrame:
    """`profile` with estimated distinct values, merged from states; highest null rate first.

    The standard error of `n_unique` is about 0.8 / sqrt(2 ** log2_buckets), under 0.7 % by default.
    """
    each = states.select(F.inline("columns"))
    merged = each.groupBy("column", "dtype").agg(F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    rate = F.col("nulls") / F.greatest(F.col("rows"), F.lit(1))
    # Null is one more value, as in the exact profile.
    unique = F.hll_sketch_estimate("sketch") + (F.col("nulls") > 0).cast("bigint")
    return merged.select("column", "dtype", "nulls", unique.alias("n_unique"), rate.alias("null_rate")).orderBy(F.desc("null_rate"), "column")


def describe(df: DataFrame) -> DataFrame:
    """Count and nulls of each column; figures of numeric ones, first and last value as text of the others.

    The basic figures are one aggregate, whose single row is unpivoted. The
    quartiles come from the counts of each column's values, all from one further
    pass: frames that are joins would be joined again for each column.
    """
    numeric = numeric_columns(df)
    figures = [*(f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType))]

    def one(name: str) -> Column:
        value = F.col(f"`{name}`")
        number = value.cast("double") if name in numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string")
        ends = (text, text) if name in numeric else (F.min(value).cast("string"), F.max(value).cast("string"))
        return F.struct(
            F.lit(name).alias("column"), F.count(value).alias("count"), F.count_if(value.isNull()).alias("null_count"),
            F.avg(number).alias("mean"), F.stddev(number).alias("std"), F.min(number).alias("min"), F.max(number).alias("max"),
            ends[0].alias("first"), ends[1].alias("last"),
        )

    basic = df.agg(F.array(*map(one, figures)).alias("found")).select(F.inline("found"))
    values = [F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("double").alias("_v")) for n in numeric]
    quarters = {"p25": nearest(0.25), "p50": nearest(0.5), "p75": nearest(0.75)}
    if values:
        counts = df.select(F.explode(F.array(*values)).alias("at")).groupBy("at.column", "at._v").agg(F.count("*").alias("_n"))
        ranked = basic.join(counted_values_at_ranks(counts, ["column"], quarters), "column", "left")
    else:
        ranked = basic.withColumns({name: F.lit(None).cast("double") for name in quarters})
    return ranked.select("column", "count", "null_count", "mean", "std", "min", *quarters, "max", "first", "last")


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def top_categories(df: DataFrame, category: str, top: int = 10) -> DataFrame:
    """Most frequent values of a column."""
    return (
        df.groupBy(category)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), category)
        .limit(top)
    )


def numeric_summary(df: DataFrame, category: str, value: str, top: int = 10) -> DataFrame:
    """Rows, mean, median, minimum and maximum per category, highest mean first.

    Everything comes from the number of rows of each category and value, so the
    rows are read once. The exact median is looked up for the top categories
    alone. Joins carry no hint: `top` may be any number.
    """
    counts = df.groupBy(category, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    number, times = F.col("_v"), F.col("_n")
    leading = (
        counts.groupBy(category)
        .agg(
            F.sum(times).alias("n_rows"),
            F.try_divide(F.sum(number * times).cast("double"), F.sum(F.when(number.isNotNull(), times))).alias(f"avg_{value}"),
            F.min(number).alias(f"min_{value}"),
            F.max(number).alias(f"max_{value}"),
        )
        .orderBy(F.desc_nulls_first(f"avg_{value}"), category)
        .limit(top)
    )
    same = F.col(category).eqNullSafe(F.col("_category"))
    # Not a semi join, which would move below the grouping and scan the rows again.
    chosen = counts.join(leading.select(F.col(category).alias("_category")), same).drop("_category")
    halves = {"_lo": below(0.5), "_hi": above(0.5)}
    middle = counted_values_at_ranks(chosen, [category], halves).select(
        F.col(category).alias("_category"),
        ((F.col("_lo").cast("double") + F.col("_hi").cast("double")) / 2).alias(f"median_{value}"),
    )
    return (
        leading.join(middle, same, "left")
        .select(category, "n_rows", f"avg_{value}", f"median_{value}", f"min_{value}", f"max_{value}")
        .orderBy(F.desc_nulls_first(f"avg_{value}"), category)
    )


def monthly_counts(df: DataFrame, day: str) -> DataFrame:
    """Rows per year and month."""
    return (
        add_date_parts(df, day)
        .groupBy("year", "month")
        .agg(F.count("*").alias("n_rows"))
        .orderBy("year", "month")
    )


def join_quality(df: DataFrame, joined: list[str]) -> DataFrame:
    """Rows, columns and nulls in the columns that a left join brought in."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        *[F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in joined],
    )
