"""Tables with a history, taken from the given ones: exchange rates and promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.plans.fixtures import read, star


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate per region on some days: those of its finished orders of every tenth customer."""
    orders = star(spark, sf_dir)["orders"]
    keyed = orders.withColumn("_customer", F.expr("CAST(substring(customer_id, 6) AS BIGINT)"))
    days = keyed.where("_customer % 10 = 0").groupBy("region", "order_date").agg(F.sum("_customer").alias("_s"))
    return days.select(
        F.col("region").alias("Region"),
        F.col("order_date").alias("rate_date"),
        F.expr("CAST(0.5 + CAST(_s % 10000 AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(9,4))").alias("rate"),
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of a part, from its first lines of orders; short ones, long ones and open ones."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    days = "CASE WHEN l_orderkey % 10 = 0 THEN 700 WHEN l_orderkey % 10 = 1 THEN 0 ELSE CAST(l_quantity AS INT) END"
    return lines.selectExpr(
        "l_partkey AS part",
        "l_orderkey AS promotion",
        "l_suppkey AS supplier",
        "CAST(l_shipdate AS DATE) AS valid_from",
        f"CASE WHEN l_orderkey % 97 <> 0 THEN date_add(CAST(l_shipdate AS DATE), {days}) END AS valid_to",
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other lines, with the day on which they were shipped."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    return lines.selectExpr("l_partkey AS part", "l_orderkey AS order_key", "l_linenumber AS line", "CAST(l_shipdate AS DATE) AS day")
