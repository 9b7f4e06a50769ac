"""Checks on the way in: rows that break a declared rule are set apart while a table is written.

Rules look at a row alone: required columns, lengths of text, and years of
departure. Each is one bit of a mask, so a row tells all that is wrong with it.
Keys and references concern several rows; see quality for these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyfacts.functions.dates import in_years
from skyfacts.schemas import FIRST_YEAR, LAST_YEAR, TABLES

#: Columns that the written table has beside its own: broken rules as bits, and the folders of kept and set apart rows.
MASK, KEPT = "broken_rules", "accepted"


def row_rules(df: DataFrame, table: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> dict[str, Column]:
    """By rule, whether a row breaks it; never null. A required column that is not there is null in every row."""
    declared = TABLES[table]
    size = F.octet_length if declared.in_bytes else F.char_length
    rules = {f"null {name}": F.col(name).isNull() if name in df.columns else F.lit(True) for name in declared.required}
    for name, limit in declared.lengths.items():
        if name in df.columns:
            rules[f"long {name}"] = F.coalesce(size(name) > limit, F.lit(False))
    if "departure" in df.columns:
        rules["year departure"] = F.coalesce(~in_years("departure", first, last), F.lit(False))
    return rules


def mask(rules: dict[str, Column]) -> Column:
    """One bit per rule in their order, set where the row breaks it."""
    bits = [F.when(broken, F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint") for at, broken in enumerate(rules.values())]
    return reduce(Column.bitwiseOR, bits, F.lit(0).cast("bigint"))


def names_of(rules: Sequence[str], bits: Column) -> Column:
    """The rules of a mask, in their order."""
    named = [F.when(bits.bitwiseAND(F.lit(1 << at)) != 0, F.lit(rule)) for at, rule in enumerate(rules)]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def broken_rules(df: DataFrame, table: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Rows per set of broken rules, as text; the empty set is the rows that are right."""
    rules = row_rules(df, table, first, last)
    counts = df.groupBy(mask(rules).alias(MASK)).agg(F.count("*").alias("n_rows"))
    return counts.select(F.array_join(names_of(list(rules), F.col(MASK)), ", ").alias("broken"), "n_rows")


@dataclass(frozen=True)
class Screened:
    """A screened table: rows that are right, the others with the names of the rules they break, and counts of the run."""

    kept: DataFrame
    quarantine: DataFrame
    rows: int
    quarantined: int
    violations: dict[str, int]


def write_screened(df: DataFrame, table: str, path: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Screened:
    """Write a table as kept and quarantined rows in two folders, with one scan of its rows.

    Every row is written once, and counts come from the write itself. A row may
    break several rules and counts in each. The columns MASK and KEPT must not
    be there already. An empty table gives two empty frames.
    """
    taken = {MASK, KEPT} & set(df.columns)
    if taken:
        raise ValueError(f"{table} has column(s) of the screening: {', '.join(sorted(taken))}")
    rules = row_rules(df, table, first, last)
    seen = Observation()
    bits = F.col(MASK)
    counted = df.withColumn(MASK, mask(rules)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(bits != 0).alias("quarantined"),
        *[F.count_if(bits.bitwiseAND(F.lit(1 << at)) != 0).alias(f"rule {at}") for at in range(len(rules))],
    )
    laid = counted.withColumn(KEPT, bits == 0)
    laid.write.mode("overwrite").partitionBy(KEPT).parquet(path)
    found = seen.get
    written = df.sparkSession.read.schema(laid.schema).parquet(path)
    apart = written.where(~F.col(KEPT)).withColumn(MASK, names_of(list(rules), bits)).drop(KEPT)
    return Screened(
        written.where(F.col(KEPT)).drop(KEPT, MASK), apart, found["rows"], found["quarantined"],
        {rule: found[f"rule {at}"] for at, rule in enumerate(rules)},
    )
