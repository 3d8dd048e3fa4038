"""Numbers as display text. Built-in expressions only, so nothing leaves the JVM.

``format_number`` rounds the exact binary value of a double, half to even, which is
what Python's and C's formatting do too; ``format_string`` rounds its shortest
decimal text and differs from them on ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display patterns and the amounts from which each one is used.
MILLIONS_FROM = 1_000_000
THOUSANDS_FROM = 1_000
MILLIONS_FORMAT = "0.00"
THOUSANDS_FORMAT = "0.0"
MONEY_FORMAT = "#,##0.00"
COUNT_FORMAT = "#,##0"
PERCENT_FORMAT = "0.0"
NO_VALUE = "N/A"


def _text(prefix: str, number: Column, pattern: str, suffix: str = "") -> Column:
    digits = F.call_function("format_number", number, F.lit(pattern))
    return F.concat(F.lit(prefix), digits, F.lit(suffix))


def money(amount: Column) -> Column:
    """``$1,234.50``; NULL stays NULL."""
    return _text("$", amount.cast("double"), MONEY_FORMAT)


def short_money(amount: Column) -> Column:
    """``$1.23M``, ``$4.5K`` or ``$678.90``; a negative amount is written in full."""
    amount = amount.cast("double")
    return (
        F.when(amount >= MILLIONS_FROM, _text("$", amount / MILLIONS_FROM, MILLIONS_FORMAT, "M"))
        .when(amount >= THOUSANDS_FROM, _text("$", amount / THOUSANDS_FROM, THOUSANDS_FORMAT, "K"))
        .otherwise(money(amount))
    )


def count(number: Column) -> Column:
    """``12,345``."""
    return _text("", number.cast("bigint"), COUNT_FORMAT)


def percent(value: Column) -> Column:
    """``12.3%``, or ``N/A`` where there is no value."""
    return F.coalesce(_text("", value.cast("double"), PERCENT_FORMAT, "%"), F.lit(NO_VALUE))
