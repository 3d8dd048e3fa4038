"""Missing values and exact constants as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text that pandas.read_csv takes for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def na_to_null(text: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Text with every missing-value token replaced by NULL."""
    return F.when(~text.isin(list(tokens)), text)


def nan_to_null(number: Column) -> Column:
    """A floating value with NaN, which Spark does not count as missing, as NULL."""
    return F.nullif(number, F.lit(float("nan")))


def dec(value: str | int, precision: int, scale: int) -> Column:
    """A DECIMAL literal."""
    return F.lit(str(value)).cast(f"decimal({precision},{scale})")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in DOUBLE that gives NULL, not an error, for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
