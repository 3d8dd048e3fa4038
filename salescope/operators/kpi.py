"""Key figures: totals, monthly growth, product and region rankings.

Grouping columns drop NULL, as a missing key belongs to no group. Rankings break
ties by name so that they come out the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.values import ratio


def total(column: str) -> Column:
    """Sum that is zero, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def average_order(revenue: Column, orders: Column) -> Column:
    return F.coalesce(ratio(revenue, orders), F.lit(0.0))


def grouped(df: DataFrame, key: str | list[str], **aggregates: Column) -> DataFrame:
    """Aggregates per key, partial on the map side, without the NULL group."""
    keys = [key] if isinstance(key, str) else key
    for k in keys:
        df = df.where(F.col(k).isNotNull())  # unlike dropna this reaches the scan
    return df.groupBy(*keys).agg(*[column.alias(name) for name, column in aggregates.items()])


def total_revenue(df: DataFrame) -> DataFrame:
    return df.agg(total("Revenue").alias("total_revenue"))


def total_profit(df: DataFrame) -> DataFrame:
    return df.agg(total("Profit").alias("total_profit"))


def total_orders(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("Order_ID").alias("total_orders"))


def total_customers(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("Customer_ID").alias("total_customers"))


def average_order_value(df: DataFrame) -> DataFrame:
    """Revenue per distinct order; zero without orders."""
    return df.agg(
        average_order(F.sum("Revenue"), F.count_distinct("Order_ID")).alias("average_order_value")
    )


def kpi_scalars(df: DataFrame) -> DataFrame:
    """The five totals as one row, from one scan; zeros for an empty frame."""
    return df.agg(
        total("Revenue").alias("total_revenue"),
        total("Profit").alias("total_profit"),
        F.count_distinct("Order_ID").alias("total_orders"),
        F.count_distinct("Customer_ID").alias("total_customers"),
    ).withColumn("average_order_value", average_order(F.col("total_revenue"), F.col("total_orders")))


def monthly_revenue(df: DataFrame) -> DataFrame:
    return grouped(df, "YearMonth", Revenue=total("Revenue")).orderBy("YearMonth")


def monthly_revenue_growth(df: DataFrame) -> DataFrame:
    """Monthly revenue and its change in percent against the month listed before.

    A month without rows is bridged; after a month without revenue the change is
    NULL. The window has one row per month, so that it needs no partitioning.
    """
    before = F.lag("Revenue").over(Window.orderBy("YearMonth"))
    change = ratio(F.col("Revenue").cast("double") - before.cast("double"), before) * 100
    return monthly_revenue(df).withColumn("Revenue_Growth_Pct", change)


def top_selling_products(df: DataFrame, n: int | None = None) -> DataFrame:
    """Products by revenue; the first ``n`` if given."""
    ranked = grouped(
        df, "Product_Name", Revenue=total("Revenue"), Quantity=total("Quantity")
    ).orderBy(F.desc("Revenue"), "Product_Name")
    return ranked if n is None else ranked.limit(n)


def best_performing_regions(df: DataFrame) -> DataFrame:
    return grouped(df, "Region", Revenue=total("Revenue"), Profit=total("Profit")).orderBy(
        F.desc("Revenue"), "Region"
    )


def calculate_kpis(df: DataFrame) -> dict[str, DataFrame]:
    """All key figures by name; each is lazy and empty input gives zeros."""
    return {
        "kpi_scalars": kpi_scalars(df),
        "monthly_revenue_growth": monthly_revenue_growth(df),
        "top_selling_products": top_selling_products(df),
        "best_performing_regions": best_performing_regions(df),
    }
