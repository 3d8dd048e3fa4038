"""Monthly figures over frames of the calendar, and ranks within a month.

A frame reaches back by months, not by rows: a month without rows is no step, and what it had
counts as nothing. So ``three months`` are never four because one is missing, and a change is given
only against the month that it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from salescope.functions.values import ratio
from salescope.operators.kpi import grouped, total

#: Months of the trailing frames, the last one included.
TRAILING = (3, 12)


def _month_number(month: str) -> str:
    """Months since year 0 of text like ``2024-01``."""
    return f"CAST(substr({month}, 1, 4) AS INT) * 12 + CAST(substr({month}, 6, 2) AS INT) - 1"


def _frame(by: Sequence[str], first: int, last: int) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_month").rangeBetween(first, last)


def monthly_frames(df: DataFrame, by: Sequence[str] = (), value: str = "Revenue") -> DataFrame:
    """Per month and group: the value, its trailing sums, year to date, and change from a year before.

    ``present_n`` tells how many months of the trailing frame of n have rows. ``year_ago`` is NULL if there
    is no row for the same month of the year before; ``year_change_pct`` is NULL then, and after zero.
    Rows without month or group are left out. Windows hold one row per month of a group.
    """
    months = grouped(df, ["YearMonth", *by], value=total(value)).withColumn("_month", F.expr(_month_number("YearMonth")))
    columns = {}
    for n in TRAILING:
        frame = _frame(by, 1 - n, 0)
        columns[f"trailing_{n}"] = F.sum("value").over(frame)
        columns[f"present_{n}"] = F.count("*").over(frame)
    year = Window.partitionBy(*by, F.expr("_month DIV 12")).orderBy("_month").rangeBetween(Window.unboundedPreceding, 0)
    columns["year_to_date"] = F.sum("value").over(year)
    columns["month_ago"] = F.sum("value").over(_frame(by, -1, -1))
    columns["year_ago"] = F.sum("value").over(_frame(by, -12, -12))
    rows = months.withColumns(columns)
    change = ratio(F.col("value").cast("double") - F.col("year_ago").cast("double"), F.col("year_ago")) * 100
    return rows.withColumn("year_change_pct", change).drop("_month").withColumnRenamed("value", value)


def monthly_ranks(df: DataFrame, by: str, value: str = "Revenue", quarters: int = 4) -> DataFrame:
    """Groups of a month by their value: rank, dense rank, share of rows below, tile, share and running share.

    Equal values share ranks; tiles and running shares take them by name. A window has one row per
    group of a month.
    """
    rows = grouped(df, ["YearMonth", by], value=total(value))
    month = Window.partitionBy("YearMonth")
    best = month.orderBy(F.desc("value"))
    named = month.orderBy(F.desc("value"), by)
    running = named.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("value").over(month)
    return rows.withColumns(
        {
            "rank": F.rank().over(best),
            "dense_rank": F.dense_rank().over(best),
            "percent_rank": F.percent_rank().over(best),
            "tile": F.ntile(quarters).over(named),
            "share_pct": ratio(F.col("value"), whole) * 100,
            "running_share_pct": ratio(F.sum("value").over(running), whole) * 100,
            "behind_best": F.max("value").over(month) - F.col("value"),
        }
    ).withColumnRenamed("value", value)
