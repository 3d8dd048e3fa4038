"""What keeps shuffled and written bytes low."""

from datetime import date
from decimal import Decimal

import pytest

from salescope.operators import clean, temporal, warehouse
from salescope.plans import fixtures
from salescope.schema import SALES, SEQ
from salescope.sources import shared
from salescope.sources.csv import load_sales_csv, save_sales_csv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def tables(spark, tmp_path):
    """Two parts, an order with a line that is there three times, and one without a date."""
    made = {
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(7, "Ann", 1)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(1, "red", "PROMO", 900.0), (2, "blue", "ECONOMY", 950.5)], "p_partkey long, p_name string, p_type string, p_retailprice double"),
        "orders": ([(10, 7, "1996-03-05", "1-URGENT"), (11, 7, None, "5-LOW")], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": (
            [(10, 2, 5, 1, 3.0, 30.0, 0.1), (10, 1, 9, 1, 2.0, 20.0, 0.0), (10, 1, 5, 1, None, 20.0, None), (10, 1, 5, 2, 8.0, 80.0, 0.05), (11, 1, 5, 1, 4.0, 40.0, 0.0)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double",
        ),
    }
    for name, (data, schema) in made.items():
        df = spark.createDataFrame(data, schema)
        if name == "lineitem":
            df = df.selectExpr("*", "TIMESTAMP '1996-04-01' AS l_shipdate")
        if name == "orders":
            df = df.selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate", "o_orderpriority")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_raw_and_complete_sales_are_read_from_one_table(spark, tables):
    with shared.landing(spark):
        complete, raw = fixtures.sales_lines(spark, tables), fixtures.sales_raw(spark, tables)
        assert complete.inputFiles() == raw.inputFiles()
        assert complete.columns == raw.columns == [*SALES.names, SEQ]


def test_cleaned_sales_are_those_of_the_general_rules(spark, tables):
    with shared.landing(spark):
        own, general = fixtures.sales_clean(spark, tables), clean.clean(fixtures.sales_raw(spark, tables))
        assert rows(own.select(general.columns)) == rows(general)
        found = {r.Order_ID: (r.Customer_ID, r.Order_Date, r[SEQ].l_suppkey) for r in own.collect()}
        assert found == {"ORD-10-1": ("CUST-7", date(1996, 3, 5), 5), "ORD-10-2": ("CUST-7", date(1996, 3, 5), 5)}


def test_known_first_rows_are_not_shuffled(spark, sales):
    df = sales({"Quantity": 1}, {"Quantity": 9, "Revenue": "50.00"}, {"Order_ID": "B", "Quantity": None, "Profit": None}, {"Order_ID": "C", "Order_Date": "bad"})
    firsts = df.where("_seq <> 1")
    cleaned = clean.clean(df, firsts=firsts)
    assert rows(cleaned) == rows(clean.clean(df))
    filled = {r.Order_ID: r.Quantity for r in cleaned.collect()}
    assert filled == {"ORD-1": 1.0, "B": 2.0}  # the median counts the copy too
    assert "Window" not in plan(cleaned).split("Subquery")[0]


def test_rows_are_sorted_in_their_narrow_form(spark, tables):
    with shared.landing(spark):
        text = plan(fixtures.sales_raw(spark, tables, in_order=True))
        assert "CUST-" not in text[text.index("Exchange") :]
        ids = [r.Order_ID for r in fixtures.sales_raw(spark, tables, in_order=True).collect()]
        assert ids[-1] == "ORD-10-1" and len(ids) == 5  # of part 2


def test_left_rows_of_an_asof_join_are_not_sorted_to_find_last_values(spark):
    left = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 3, 1)), ("b", date(2024, 3, 1)), (None, date(2024, 3, 1))], "k string, d date")
    right = spark.createDataFrame([("a", date(2024, 1, 1), 1), ("a", date(2024, 2, 1), 2), ("c", date(2024, 2, 1), 3)], "k string, at date, v int")
    found = temporal.asof_join(left, right, "k", "d", "at", ["v"])
    assert "max(CASE WHEN" not in plan(found)
    assert rows(found.select("k", "v")) == rows(spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, None)], "k string, v int"))


def test_orders_find_customers_before_sales_do(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(warehouse.sales_summary_view(fixtures.star(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.index("SortMergeJoin [order_id") < text.index("SortMergeJoin [customer_id")


def test_compressed_csv_is_read_as_it_is(spark, sales, tmp_path):
    df = sales({"Customer_Name": ' "Ann", '}, {"Order_ID": "B", "Profit": None, "Revenue": "1.50"})
    save_sales_csv(df, f"{tmp_path}/plain")
    save_sales_csv(df, f"{tmp_path}/packed", compression="gzip")
    assert list((tmp_path / "packed").glob("*.csv.gz")) and not list((tmp_path / "packed").glob("*.csv"))
    plain, packed = (load_sales_csv(spark, f"{tmp_path}/{name}").drop(SEQ) for name in ("plain", "packed"))
    assert rows(packed) == rows(plain) and {r.Revenue for r in packed.collect()} == {Decimal("20"), Decimal("1.5")}
