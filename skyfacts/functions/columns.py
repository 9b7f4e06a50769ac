"""Column names, types and optional filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL = "All"


def normalize_names(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def standardize_names(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names with underscores for spaces."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def where_equal(df: DataFrame, name: str | None, value: object | None) -> DataFrame:
    """Equality filter that is skipped when nothing, or All, is chosen."""
    if not name or value is None or value == "" or value == ALL:
        return df
    return df.where(F.col(name) == F.lit(value))


def where_in(df: DataFrame, name: str, chosen: Iterable[object] | None) -> DataFrame:
    """Keep the chosen values; no choice means every non-null value."""
    values = list(chosen or [])
    column = F.col(name)
    return df.where(column.isin(values) if values else column.isNotNull())


def option_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-null values of a column in ascending order."""
    return df.select(name).dropna().distinct().orderBy(name)


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)


def title_case(value: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere.

    initcap only starts a word after a blank, so a marked blank is put behind
    each non-letter and taken out again.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(value, r"(\P{L})", "$1" + mark)
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def percent_text(share: Column) -> Column:
    """A share as percent with one decimal, such as 93.4%."""
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def amount_text(value: Column, decimals: int = 0) -> Column:
    """A number with thousands separators; 0 when there is none."""
    return F.coalesce(F.format_number(value.cast("double"), decimals), F.lit("0"))
