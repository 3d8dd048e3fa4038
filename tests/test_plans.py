"""What the physical plans must and must not contain."""

import re

import pytest

from salescope.functions.quantiles import exact_quantiles
from salescope.operators import clean, filters, kpi
from salescope.plans.fixtures import sales_clean, sales_raw, star
from salescope.plans.queries import registry

QUERIES = registry()

# Read back what they wrote or train before they return; their plans are a plain scan.
EAGER = {"load_sales_csv", "csv_round_trip", "save_sales_csv", "load_customers", "load_products", "load_orders", "load_sales"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES.keys() - EAGER))
def test_no_python_and_no_pairs_of_all_rows(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert node not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = filters.apply_filters(
        sales_clean(spark, sf_dir), ("1996-03-01", "1996-05-31"), ["ASIA"], ["PROMO"], ["2-HIGH"]
    )
    ranked = kpi.top_selling_products(df)
    text = spark._jvm.PythonSQLUtils.explainString(ranked._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "Region" in pushed and "Product_Category" in pushed and "Order_Date" in pushed
    partitions = re.search(r"PartitionFilters: \[(.*?)\]\n", text).group(1)
    assert "YearMonth" in partitions and "1996-03" in partitions
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "Customer_Name" not in schema and "_seq" not in schema


def test_dedupe_drops_copies_before_the_shuffle(spark, sf_dir):
    text = plan(clean.dedupe_keep_first(sales_raw(spark, sf_dir)))
    below_shuffle = text[text.index("Exchange") :]
    assert re.search(r"WindowGroupLimit .*Partial", below_shuffle)


def test_counts_are_combined_before_each_shuffle(spark, sf_dir):
    text = plan(kpi.monthly_revenue(sales_clean(spark, sf_dir)))
    assert "partial_sum" in text[text.index("Exchange") :]


def test_quantiles_never_gather_a_column(spark, sf_dir):
    text = plan(exact_quantiles(sales_raw(spark, sf_dir), ["Revenue"], [0.5]))
    for node in ("percentile(", "median", "SortMergeJoin"):
        assert node not in text
    # All that meets in one task are the buckets that the ranks fall in, two for each at most.
    for below in text.split("Exchange SinglePartition")[1:]:
        assert "partial_collect_list(struct(name, " in below.split("\n")[1]


def scans(df):
    """File scans that a query has run, each once however many places use its result."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    return final.count("FileScan")


def test_quantiles_take_one_scan_for_each_pass(spark, sf_dir):
    rows = sales_raw(spark, sf_dir)
    assert scans(exact_quantiles(rows, ["Revenue", "Profit"], [0.25, 0.5])) <= 3
    assert scans(clean.impute_median(rows, ["Revenue"])) <= 4  # and one for the rows themselves


def test_growth_window_runs_on_monthly_rows(spark, sf_dir):
    text = plan(kpi.monthly_revenue_growth(sales_clean(spark, sf_dir)))
    single = text.index("Exchange SinglePartition")
    assert "HashAggregate" in text[single:]  # the rows it moves are aggregated already


def test_small_dimensions_are_broadcast_by_size_not_by_hint(spark, sf_dir):
    tables = star(spark, sf_dir)
    flat = tables["sales"].join(tables["orders"], "order_id")
    assert "BroadcastHashJoin" in plan(flat)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(tables["sales"].join(tables["orders"], "order_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
