from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salescope.functions.values import na_to_null, nan_to_null
from salescope.operators import clean
from salescope.schema import CLEAN_COLUMNS


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_discount_and_profit_are_filled(sales):
    df = clean.handle_missing_values(
        sales({"Discount": None}, {"Order_ID": "ORD-2", "Profit": None, "Revenue": "33.33"})
    )
    assert rows(df, "Order_ID", "Discount", "Profit") == [
        ("ORD-1", Decimal("0.0000"), Decimal("5.0000")),
        ("ORD-2", Decimal("0.0000"), Decimal("9.9990")),
    ]


def test_profit_uses_revenue_before_its_median_is_filled(sales):
    df = clean.handle_missing_values(
        sales(
            {"Order_ID": "A", "Profit": "4.00", "Revenue": "10.00"},
            {"Order_ID": "B", "Profit": None, "Revenue": "20.00"},
            {"Order_ID": "C", "Profit": None, "Revenue": None},
        )
    )
    # C has no revenue to start from, so it gets the median of 4 and 6.
    assert rows(df, "Order_ID", "Revenue", "Profit") == [
        ("A", Decimal("10.0000"), Decimal("4.0000")),
        ("B", Decimal("20.0000"), Decimal("6.0000")),
        ("C", Decimal("15.0000"), Decimal("5.0000")),
    ]


def test_median_of_whole_numbers_may_lie_halfway(sales):
    df = clean.impute_median(
        sales({"Quantity": 1}, {"Quantity": 4}, {"Quantity": None}), ["Quantity"]
    )
    assert rows(df, "Quantity") == [(1.0,), (2.5,), (4.0,)]


def test_column_without_values_stays_empty(sales):
    df = clean.handle_missing_values(sales({"Unit_Price": None}, {"Unit_Price": None}))
    assert rows(df, "Unit_Price") == [(None,), (None,)]


def test_missing_text_is_unknown_and_missing_ids_fall_together(sales):
    df = sales(
        {"Order_ID": None, "Region": None}, {"Order_ID": None}, {"Order_ID": None, "Quantity": 9}
    )
    cleaned = clean.clean(df)
    assert rows(cleaned, "Order_ID", "Region", "Quantity") == [("Unknown", "Unknown", 2.0)]


@pytest.mark.parametrize("text,kept", [("2024-01-05", 1), ("2024-13-01", 0), ("soon", 0), (None, 0)])
def test_rows_without_a_valid_date_are_dropped(sales, text, kept):
    assert clean.clean(sales({"Order_Date": text})).count() == kept


def test_a_bad_first_copy_takes_the_order_with_it(sales):
    df = sales({"Order_Date": "bad"}, {"Order_Date": "2024-01-05"}, {"Order_ID": "ORD-2"})
    assert rows(clean.clean(df), "Order_ID") == [("ORD-2",)]


def test_first_copy_is_kept_in_input_order(spark, sales):
    df = sales(*[{"Quantity": q} for q in (7, 1, 9)], {"Order_ID": "ORD-2", "Quantity": 3})
    shuffled = df.repartition(5, "Quantity")
    assert rows(clean.dedupe_keep_first(shuffled), "Order_ID", "Quantity") == [("ORD-1", 7), ("ORD-2", 3)]


def test_dedupe_by_other_keys_treats_null_as_equal(sales):
    df = sales({"Region": None, "Quantity": 1}, {"Region": None, "Quantity": 2}, {"Region": "South"})
    kept = clean.dedupe_keep_first(df, ["Region", "Sales_Channel"])
    assert rows(kept, "Region", "Quantity") == [(None, 1), ("South", 2)]


def test_date_parts(sales):
    cleaned = clean.clean(sales({"Order_Date": "2023-11-30"}))
    assert rows(cleaned, "Year", "Month", "YearMonth", "Quarter") == [(2023, 11, "2023-11", 4)]
    assert set(CLEAN_COLUMNS) <= set(cleaned.columns)


def test_cleaning_twice_changes_nothing(sales):
    df = sales(
        {"Discount": None, "Region": None},
        {"Order_ID": "B", "Profit": None},
        {"Order_ID": "C", "Quantity": None},
        {"Order_ID": "C"},
    )
    once = clean.clean(df)
    twice = clean.clean(once)
    columns = ["Order_ID", "Region", "Quantity", "Discount", "Profit", "YearMonth"]
    assert rows(once, *columns) == rows(twice, *columns)


def test_empty_input_gives_typed_empty_output(sales):
    cleaned = clean.clean(sales({}).limit(0))
    assert cleaned.count() == 0
    assert dict(cleaned.dtypes)["Order_Date"] == "date"


def test_missing_value_tokens(spark):
    words = ["NA", "N/A", "null", "NaN", "", "None", "Nation", "0"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    kept = [r[0] for r in df.select(na_to_null(F.col("word"))).collect() if r[0] is not None]
    assert kept == ["Nation", "0"]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert [r[0] for r in numbers.select(nan_to_null(F.col("x"))).collect()] == [1.0, None]


def test_line_amounts_are_exact_to_the_cent(spark):
    df = spark.sql("SELECT 3 AS q, 19.99BD AS p, 0.15BD AS d, 0.70BD AS c")
    row = df.select(
        clean.line_revenue(F.col("q"), F.col("p"), F.col("d")).alias("revenue"),
        clean.line_profit(F.lit("100.05"), F.col("c")).alias("profit"),
    ).first()
    assert (row.revenue, row.profit) == (Decimal("50.97"), Decimal("30.02"))


def test_the_position_is_no_value_to_fill(sales):
    df = clean.handle_missing_values(sales({}, {"Quantity": None}))
    assert dict(df.dtypes)["_seq"] == "bigint"


def test_dates_in_several_notations_are_kept(sales):
    texts = {
        "2024-01-01": "2024-01-01",
        "2024-01-01 00:00:00": "2024-01-01",
        "2024-01-02T10:11:12.123": "2024-01-02",
        "2024/01/05": "2024-01-05",
        "01/31/2024": "2024-01-31",
        "20240203": "2024-02-03",
    }
    bad = ["2024-13-01", "soon", "10:30", "2024"]
    rows = sales(*[{"Order_ID": t, "Order_Date": t} for t in [*texts, *bad]])
    assert {r.Order_ID: str(r.Order_Date) for r in clean.coerce_dates(rows).collect()} == texts
    assert clean.coerce_dates(rows, fmt="yyyy/MM/dd").count() == 1
