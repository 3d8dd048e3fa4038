"""Row filters, the choices they offer, and projections."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns a user can filter on by value.
FILTER_COLUMNS = ["Region", "Product_Category", "Sales_Channel"]


def filter_date_range(df: DataFrame, date_range: Sequence[Any] | None) -> DataFrame:
    """Rows from the first to the last day, both included.

    Anything but two bounds means no filter. The months follow from the days; saying
    so lets a table stored by ``YearMonth`` skip whole partitions.
    """
    if not date_range or len(date_range) != 2:
        return df
    first, last = (F.lit(bound).cast("date") for bound in date_range)
    df = df.where(F.col("Order_Date").between(first, last))
    if "YearMonth" in df.columns:
        months = (F.date_format(bound, "yyyy-MM") for bound in (first, last))
        df = df.where(F.col("YearMonth").between(*months))
    return df


def filter_values(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose value is in the list; an empty list means no filter."""
    return df.where(F.col(column).isin(list(values))) if values else df


def filter_region(df: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    return filter_values(df, "Region", regions)


def filter_category(df: DataFrame, categories: Sequence[str] | None) -> DataFrame:
    return filter_values(df, "Product_Category", categories)


def filter_channel(df: DataFrame, channels: Sequence[str] | None) -> DataFrame:
    return filter_values(df, "Sales_Channel", channels)


def apply_filters(
    df: DataFrame,
    date_range: Sequence[Any] | None = None,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """All filters together. They commute, and all of them reach the scan."""
    return (
        df.transform(lambda d: filter_date_range(d, date_range))
        .transform(lambda d: filter_region(d, regions))
        .transform(lambda d: filter_category(d, categories))
        .transform(lambda d: filter_channel(d, channels))
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last order date, as one row."""
    return df.agg(F.min("Order_Date").alias("min_date"), F.max("Order_Date").alias("max_date"))


def filter_options(df: DataFrame, columns: Sequence[str] = FILTER_COLUMNS) -> DataFrame:
    """Sorted distinct values of the filter columns, as (dimension, value)."""
    return (
        df.select(*columns)
        .unpivot([], list(columns), "dimension", "value")
        .where("value IS NOT NULL")
        .distinct()
        .orderBy("dimension", "value")
    )


def is_empty(df: DataFrame) -> DataFrame:
    """One row telling whether there are no rows; reads one row at most."""
    return df.limit(1).agg((F.count("*") == 0).alias("is_empty"))


def select_rename(df: DataFrame, names: dict[str, str] | Sequence[str]) -> DataFrame:
    """The named columns only, renamed if a mapping is given."""
    names = names if isinstance(names, dict) else {c: c for c in names}
    return df.select([F.col(old).alias(new) for old, new in names.items()])


def drop_null_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in each of the columns."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df
