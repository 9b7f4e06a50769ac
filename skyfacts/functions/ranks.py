"""Exact order statistics without sorting a group in one task.

Spark's own percentile keeps every distinct value of a group in one task. Here
equal values are merged first, so a value that a third of the rows hold is one
row. Each pass then counts a group's values in buckets, which merge map-side to
a bounded histogram, and keeps only the buckets that hold a wanted rank. The
first buckets have equal ratio; later passes split each bucket between the
least and greatest value seen in it. The type of the value gives the number of
passes: after them a bucket holds at most 2 ** MOST_DIGITS different values, and
for evenly spread ones a single value.

Nothing runs before an action, and no side is broadcast by a hint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RankRule = Callable[[Column], Column]

BUCKETS = 1 << 16
BUCKETS_PER_E = 1024
MOST_DIGITS = 22

# Binary digits that tell the values of a type apart.
DIGITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63, T.FloatType: 24, T.DoubleType: 53}


def nearest(q: float) -> RankRule:
    """Zero-based rank round(q * (n - 1)), half away from zero."""
    return lambda n: F.floor(F.lit(q) * (n - 1) + F.lit(0.5)).cast("bigint")


def below(q: float) -> RankRule:
    return lambda n: F.floor(F.lit(q) * (n - 1)).cast("bigint")


def above(q: float) -> RankRule:
    return lambda n: F.ceil(F.lit(q) * (n - 1)).cast("bigint")


def passes(kind: T.DataType) -> int:
    """Refinements after which a first bucket of this type's values holds few enough of them for one task."""
    digits = ceil(kind.precision * log2(10)) if isinstance(kind, T.DecimalType) else DIGITS[type(kind)]
    return max(1, ceil((digits - log2(BUCKETS_PER_E) - MOST_DIGITS) / log2(BUCKETS)))


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rules: Mapping[str, RankRule], refinements: int | None = None
) -> DataFrame:
    """One row per group with the value at each named rank of its non-null values."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return counted_values_at_ranks(counts, keys, rules, refinements)


def counted_values_at_ranks(
    counts: DataFrame, keys: Sequence[str], rules: Mapping[str, RankRule], refinements: int | None = None
) -> DataFrame:
    """As values_at_ranks, from the number `_n` of rows of each key and value `_v`."""
    keys = list(keys)
    times = passes(counts.schema["_v"].dataType) if refinements is None else refinements
    # The null test takes in the count, so it stays above the grouping and other uses of `counts` share its shuffle.
    known = F.when(F.col("_n") > 0, F.col("_v")).isNotNull()
    rows = counts.where(known).withColumn("_b", _first_bucket(F.col("_v")))
    targets = _first_brackets(rows, keys, rules)
    group = [*keys, "_b", "_t"]
    low, high = (F.col(f"_t.{end}").cast("double") for end in ("lo", "hi"))
    bucket = F.coalesce(F.width_bucket(F.col("_v").cast("double"), low, high, F.lit(BUCKETS)), F.lit(0))
    for _ in range(times):
        inside = _in_bracket(rows, targets, keys).withColumn("_s", bucket)
        histogram = inside.groupBy(*group, "_s").agg(*_tally())
        targets = _brackets(histogram, group, "_s", keys)
    exact = _in_bracket(rows, targets, keys).withColumnRenamed("_n", "n")
    found = _running(exact, group, "_v").select(*keys, "_v", F.explode(_ranks_here()).alias("w"))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("w.name") == name, F.col("_v"))).alias(name) for name in rules]
    )


def _tally() -> list[Column]:
    return [F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")]


def _first_bucket(value: Column) -> Column:
    """Buckets of equal ratio, which need no known range and never run against the order."""
    number = value.cast("double")
    scaled = F.floor(F.signum(number) * F.log1p(F.abs(number)) * F.lit(BUCKETS_PER_E))
    return F.when(F.isnan(number), F.lit(2**63 - 1)).otherwise(scaled)


def _first_brackets(rows: DataFrame, keys: list[str], rules: Mapping[str, RankRule]) -> DataFrame:
    histogram = rows.groupBy(*keys, "_b").agg(*_tally())
    total = F.sum("n").over(Window.partitionBy(*keys))
    wanted = [F.struct(F.lit(name).alias("name"), rule(total).alias("rank")) for name, rule in rules.items()]
    whole = F.struct(F.lit(0).cast("bigint").alias("base"), F.array(*wanted).alias("wanted"))
    return _brackets(histogram.withColumn("_t", whole), keys, "_b", keys)


def _brackets(histogram: DataFrame, group: list[str], order: str, keys: list[str]) -> DataFrame:
    """The buckets that hold a wanted rank, each with its bounds, its ranks and the count before it."""
    before = (F.col("upto") - F.col("n")).alias("base")
    bracket = F.struct("lo", "hi", before, _ranks_here().alias("wanted")).alias("_t")
    return _running(histogram, group, order).select(*keys, "_b", bracket).where(F.size("_t.wanted") > 0)


def _ranks_here() -> Column:
    """The wanted ranks that fall in the row's run of n values ending at upto."""
    return F.filter(
        "_t.wanted", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n"))
    )


def _in_bracket(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that lie in one of their group's brackets.

    The first bucket is part of the join key, and a key is split further by
    adaptive execution where it is skewed. The bounds are tested so that no null
    test on the computed bucket is pushed below it and evaluated twice.
    """
    names = [*keys, "_b"]
    lookup = targets.select(*[F.col(k).alias(f"_k_{k}") for k in names], "_t")
    matches = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names]
    matches.append(F.coalesce(F.col("_v").between(F.col("_t.lo"), F.col("_t.hi")), F.lit(False)))
    return rows.join(lookup, matches).select(*names, "_v", "_n", "_t")


def _running(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds the count of the group's values up to and including each row."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(window) + F.col("_t.base"))
