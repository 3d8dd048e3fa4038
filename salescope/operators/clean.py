"""Cleaning of flat sales rows: missing values, duplicates, dates.

The order matters and is kept by :func:`clean`: values are filled while the date
is still text, duplicates go before bad dates do, and the profit estimate uses
the revenue before medians are filled in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions.quantiles import quantile_row
from salescope.functions.values import dec, nan_to_null
from salescope.schema import RATIO, RAW_MONEY, SEQ, clean_money

# What replaces a missing entry.
UNKNOWN = "Unknown"
NO_DISCOUNT = 0
ASSUMED_MARGIN = "0.30"
#: Patterns that a date may have, the likeliest first; a time of day is dropped.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "yyyyMMdd",
)


def line_revenue(quantity: Column, unit_price: Column, discount: Column) -> Column:
    """Quantity times price less discount, to the cent."""
    kept = dec(1, 5, 4) - discount.cast(RATIO)
    amount = quantity.cast("decimal(9,0)") * unit_price.cast("decimal(10,2)") * kept
    return amount.cast(RAW_MONEY)


def line_profit(revenue: Column, cost_ratio: Column) -> Column:
    """The part of the revenue that is not cost, to the cent."""
    return (revenue.cast(RAW_MONEY) * (dec(1, 5, 4) - cost_ratio.cast(RATIO))).cast(RAW_MONEY)


def _columns_of(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name != SEQ]


def fill_discount(df: DataFrame) -> DataFrame:
    """A missing discount is no discount."""
    if "Discount" not in df.columns:
        return df
    return df.withColumn(
        "Discount", F.coalesce("Discount", F.lit(NO_DISCOUNT).cast(df.schema["Discount"].dataType))
    )


def derive_profit(df: DataFrame) -> DataFrame:
    """A missing profit is 30 % of the revenue, unrounded."""
    if not {"Profit", "Revenue"} <= set(df.columns):
        return df
    kinds = [df.schema[c].dataType for c in ("Profit", "Revenue")]
    if not all(isinstance(k, T.DecimalType) for k in kinds):
        estimate = F.col("Revenue").cast("double") * float(ASSUMED_MARGIN)
        return df.withColumn("Profit", F.coalesce(F.col("Profit").cast("double"), estimate))
    kind = max(map(clean_money, kinds), key=lambda k: (k.scale, k.precision))
    estimate = F.col("Revenue").cast(kind) * dec(ASSUMED_MARGIN, 3, 2)
    return df.withColumn("Profit", F.coalesce(F.col("Profit").cast(kind), estimate.cast(kind)))


def _filled(df: DataFrame, name: str, value: Column) -> Column:
    """The column with ``value`` where it is missing; whole numbers as DOUBLE, money with four decimals."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        kind = kind if name == "Discount" else clean_money(kind)
    else:
        kind = T.DoubleType()
    return F.coalesce(F.col(name).cast(kind), value.cast(kind))


def impute_median(df: DataFrame, columns: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """Missing numbers become the median of their column, in ``df`` or in the table ``of``.

    The medians are one row, computed by the scalable exact quantiles and read
    back as a scalar subquery. Whole-number columns become DOUBLE, as a median may
    lie halfway; money gets four decimals. A column without any value stays empty.
    """
    columns = _columns_of(df, T.NumericType) if columns is None else columns
    if not columns:
        return df
    row = quantile_row(df if of is None else of, columns, [0.5])
    medians = row.select(F.struct(*[F.col(c)[0].alias(c) for c in columns]).alias("m")).scalar()
    # Attached as a column first, so that the plan holds the subquery once.
    return (
        df.withColumn("_medians", medians)
        .withColumns({c: _filled(df, c, F.col("_medians").getField(c)) for c in columns})
        .drop("_medians")
    )


def impute_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Missing numbers become given values, such as medians of earlier rows."""
    return df.withColumns({c: _filled(df, c, F.lit(v)) for c, v in values.items()})


def fill_unknown(df: DataFrame) -> DataFrame:
    """Missing text becomes ``Unknown``; so does a date that is still text."""
    return df.fillna(UNKNOWN, subset=_columns_of(df, T.StringType))


def _estimated(df: DataFrame) -> DataFrame:
    """The fill rules that need no other row."""
    floats = _columns_of(df, T.DoubleType, T.FloatType)
    df = df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df
    return df.transform(fill_discount).transform(derive_profit)


def handle_missing_values(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """All the fill rules, in the order that the estimates depend on; medians are those ``of`` a table, or of ``df``."""
    # Discounts are complete after the first rule and need no median.
    numbers = [c for c in _columns_of(df, T.NumericType) if c != "Discount"]
    whole = None if of is None else _estimated(of)
    return df.transform(_estimated).transform(lambda d: impute_median(d, numbers, whole)).transform(fill_unknown)


def copy_number(keys: list[str], order: list[str]) -> Column:
    """The place of a row among those of its key, from 1 in input order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def dedupe_keep_first(
    df: DataFrame, keys: list[str] | None = None, order: str | list[str] = SEQ
) -> DataFrame:
    """First row per key in input order; NULL keys count as equal.

    Spark turns the filter on ``row_number`` into a group limit that runs before
    the shuffle too, so a key with very many copies sends one row per task.
    """
    keys = keys or ["Order_ID"]
    order = [order] if isinstance(order, str) else order
    return df.withColumn("_rank", copy_number(keys, order)).where("_rank = 1").drop("_rank")


def coerce_dates(
    df: DataFrame, column: str = "Order_Date", fmt: str | Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Text to DATE by the first pattern that fits; rows without a valid date are dropped.

    A pattern with an offset is read in the time zone of the session.
    """
    if isinstance(df.schema[column].dataType, T.StringType):
        formats = [fmt] if isinstance(fmt, str) else fmt
        text = F.trim(column)
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])
    else:
        parsed = F.to_date(column)
    return df.withColumn(column, parsed).where(F.col(column).isNotNull())


def date_parts(df: DataFrame, column: str = "Order_Date") -> DataFrame:
    """Adds Year, Month, YearMonth (``2024-01``) and Quarter."""
    day = F.col(column)
    return df.withColumns(
        {
            "Year": F.year(day),
            "Month": F.month(day),
            "YearMonth": F.date_format(day, "yyyy-MM"),
            "Quarter": F.quarter(day),
        }
    )


def convert_dates(
    df: DataFrame, column: str = "Order_Date", fmt: str | Sequence[str] = DATE_FORMATS
) -> DataFrame:
    return date_parts(coerce_dates(df, column, fmt), column)


def clean(df: DataFrame, keys: list[str] | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """Fill, deduplicate, date: the cleaned table with its ``_seq`` still there.

    ``firsts`` are the first rows per key of ``df``, where a stored :func:`copy_number` tells them: then
    no row is shuffled for that. Medians are those of all rows either way.
    """
    if firsts is not None:
        return convert_dates(handle_missing_values(firsts, of=df))
    return (
        df.transform(handle_missing_values)
        .transform(lambda d: dedupe_keep_first(d, keys))
        .transform(convert_dates)
    )
