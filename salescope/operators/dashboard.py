"""The datasets behind the charts and tables of a sales dashboard.

Each takes the filtered rows. Nothing is drawn here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions import formats
from salescope.functions.quantiles import quantile_row
from salescope.functions.values import ratio
from salescope.operators import kpi, profile
from salescope.operators.kpi import grouped, total

# Lengths of the product lists and names of the customer tiers.
CHART_PRODUCTS = 10
TABLE_PRODUCTS = 15
TIERS = ["Low", "Medium", "High", "Top"]


def monthly_trend(df: DataFrame) -> DataFrame:
    return kpi.monthly_revenue(df)


def revenue_by_region(df: DataFrame) -> DataFrame:
    return profile.revenue_by_region(df)


def revenue_by_category(df: DataFrame) -> DataFrame:
    """Revenue per category and its share of the whole in percent."""
    categories = grouped(df, "Product_Category", Revenue=total("Revenue"))
    whole = categories.select(F.sum("Revenue")).scalar()
    return categories.withColumn("Share_Pct", ratio(F.col("Revenue"), whole) * 100).orderBy(
        F.desc("Revenue"), "Product_Category"
    )


def top_products(df: DataFrame) -> DataFrame:
    return kpi.top_selling_products(df, CHART_PRODUCTS)


def product_profitability(df: DataFrame) -> DataFrame:
    """Revenue, profit and margin of each product within its category."""
    return grouped(
        df,
        ["Product_Name", "Product_Category"],
        Revenue=total("Revenue"),
        Profit=total("Profit"),
    ).withColumn("Margin_Pct", ratio(F.col("Profit"), F.col("Revenue")) * 100)


def customer_segmentation(df: DataFrame) -> DataFrame:
    """Customers, revenue and mean revenue per customer of four revenue tiers.

    The rule is this library's own: the quartiles of revenue per customer are the
    cut points, and a customer on a cut belongs to the tier below it. The quartiles
    come from a scalar subquery, so customers are never put in one global order.
    """
    customers = grouped(df, "Customer_ID", Revenue=total("Revenue"))
    cuts = quantile_row(customers, ["Revenue"], profile.QUARTILES).scalar()
    tier = F.lit(TIERS[-1])
    for i in reversed(range(len(profile.QUARTILES))):
        tier = F.when(F.col("Revenue").cast("double") <= F.col("cuts")[i], TIERS[i]).otherwise(tier)
    return (
        customers.withColumn("cuts", cuts)
        .groupBy(tier.alias("Segment"))
        .agg(F.count("*").alias("Customers"), F.sum("Revenue").alias("Revenue"))
        .withColumn("Avg_Revenue", ratio(F.col("Revenue"), F.col("Customers")))
    )


def channel_performance(df: DataFrame) -> DataFrame:
    """Revenue, profit and distinct orders per sales channel, best first."""
    return grouped(
        df,
        "Sales_Channel",
        Revenue=total("Revenue"),
        Profit=total("Profit"),
        Orders=F.count_distinct("Order_ID"),
    ).orderBy(F.desc("Revenue"), "Sales_Channel")


def forecast_series(history: DataFrame, predictions: DataFrame) -> DataFrame:
    """Past and predicted revenue by month, told apart by ``kind``."""
    past = history.select(
        "YearMonth", F.col("Revenue").cast("double").alias("Revenue"), F.lit("history").alias("kind")
    )
    future = predictions.select(
        "YearMonth", F.col("Predicted_Revenue").alias("Revenue"), F.lit("forecast").alias("kind")
    )
    return past.unionByName(future).orderBy("YearMonth", "kind")


def format_currency(amount: Column) -> Column:
    return formats.short_money(amount)


def kpi_cards(df: DataFrame) -> DataFrame:
    """The totals as the text shown on the cards, one row per card."""
    cards = {
        "Total Revenue": formats.short_money(F.col("total_revenue")),
        "Total Profit": formats.short_money(F.col("total_profit")),
        "Total Orders": formats.count(F.col("total_orders")),
        "Average Order Value": formats.short_money(F.col("average_order_value")),
        "Total Unique Customers": formats.count(F.col("total_customers")),
    }
    entries = [
        F.struct(F.lit(title).alias("title"), text.alias("text")) for title, text in cards.items()
    ]
    return kpi.kpi_scalars(df).select(F.inline(F.array(*entries)))


def growth_table(df: DataFrame) -> DataFrame:
    """Monthly revenue and growth as text."""
    return kpi.monthly_revenue_growth(df).select(
        "YearMonth",
        formats.money(F.col("Revenue")).alias("Revenue"),
        formats.percent(F.col("Revenue_Growth_Pct")).alias("Revenue_Growth_Pct"),
    )


def top_products_table(df: DataFrame) -> DataFrame:
    """The best products, revenue as text."""
    return kpi.top_selling_products(df, TABLE_PRODUCTS).withColumn(
        "Revenue", formats.money(F.col("Revenue"))
    )


def regions_table(df: DataFrame) -> DataFrame:
    """Regions with revenue and profit as text."""
    return kpi.best_performing_regions(df).withColumns(
        {c: formats.money(F.col(c)) for c in ("Revenue", "Profit")}
    )
