import datetime

import pytest

from salescope.operators import clean, dashboard, filters, kpi
from pyspark.sql import functions as F


@pytest.fixture
def cleaned(sales):
    return clean.clean(
        sales(
            {"Order_ID": "A", "Order_Date": "2024-01-31", "Region": "North", "Revenue": "100.00"},
            {"Order_ID": "B", "Order_Date": "2024-03-01", "Region": "South", "Revenue": "150.00"},
            {"Order_ID": "C", "Order_Date": "2024-04-01", "Region": "South", "Revenue": "0.00"},
            {"Order_ID": "D", "Order_Date": "2024-05-02", "Customer_ID": "C2", "Revenue": "30.00"},
        )
    )


def ids(df):
    return sorted(r.Order_ID for r in df.collect())


def test_date_range_includes_both_days(cleaned):
    df = filters.filter_date_range(cleaned, ("2024-01-31", datetime.date(2024, 3, 1)))
    assert ids(df) == ["A", "B"]


@pytest.mark.parametrize("dates", [None, (), ("2024-01-31",), ("2024-01-31", "2024-02-01", "2024-03-01")])
def test_anything_but_two_dates_is_no_filter(cleaned, dates):
    assert ids(filters.filter_date_range(cleaned, dates)) == ["A", "B", "C", "D"]


def test_an_empty_list_is_no_filter(cleaned):
    df = filters.apply_filters(cleaned, None, [], [], None)
    assert ids(df) == ["A", "B", "C", "D"]
    assert ids(filters.apply_filters(cleaned, regions=["South"])) == ["B", "C"]
    assert filters.is_empty(filters.filter_channel(cleaned, ["Fax"])).first().is_empty


def test_filters_commute(cleaned):
    dates, regions = ("2024-02-01", "2024-12-31"), ["South"]
    one = filters.filter_region(filters.filter_date_range(cleaned, dates), regions)
    other = filters.filter_date_range(filters.filter_region(cleaned, regions), dates)
    assert ids(one) == ids(other) == ["B", "C"]


def test_options_and_bounds(cleaned):
    options = [tuple(r) for r in filters.filter_options(cleaned).collect()]
    assert ("Region", "North") in options and len(options) == 4
    bounds = filters.date_bounds(cleaned).first()
    assert bounds.min_date == datetime.date(2024, 1, 31)
    assert bounds.max_date == datetime.date(2024, 5, 2)


def test_select_rename(cleaned):
    assert filters.select_rename(cleaned, {"Order_ID": "Order"}).columns == ["Order"]
    assert filters.select_rename(cleaned, ["Region"]).columns == ["Region"]


def test_growth_bridges_months_and_survives_zero(cleaned):
    growth = {r.YearMonth: r.Revenue_Growth_Pct for r in kpi.monthly_revenue_growth(cleaned).collect()}
    assert growth == {"2024-01": None, "2024-03": 50.0, "2024-04": -100.0, "2024-05": None}


def test_totals(cleaned):
    row = kpi.kpi_scalars(cleaned).first()
    assert float(row.total_revenue) == 280.0
    assert (row.total_orders, row.total_customers) == (4, 2)
    assert row.average_order_value == 70.0


def test_empty_input_gives_zeros(cleaned):
    kpis = kpi.calculate_kpis(cleaned.limit(0))
    assert [float(v) for v in kpis["kpi_scalars"].first()] == [0.0] * 5
    assert kpis["monthly_revenue_growth"].count() == 0
    assert kpis["top_selling_products"].columns == ["Product_Name", "Revenue", "Quantity"]


def test_null_keys_form_no_group_and_all_null_sums_are_zero(sales):
    df = sales({"Region": None}, {"Region": "North", "Revenue": None})
    assert [(r.Region, float(r.Revenue)) for r in kpi.best_performing_regions(df).collect()] == [
        ("North", 0.0)
    ]


def test_ranking_ties_are_broken_by_name(sales):
    df = sales({"Product_Name": "Z"}, {"Product_Name": "A"}, {"Product_Name": "M", "Revenue": "99.00"})
    assert [r.Product_Name for r in kpi.top_selling_products(df).collect()] == ["M", "A", "Z"]


@pytest.mark.parametrize(
    "amount,text",
    [
        (-5, "$-5.00"),
        (-1234567, "$-1,234,567.00"),
        (0, "$0.00"),
        (999.99, "$999.99"),
        (1000, "$1.0K"),
        (999999.99, "$1000.0K"),
        (1000000, "$1.00M"),
        (None, None),
    ],
)
def test_currency(spark, amount, text):
    df = spark.createDataFrame([(None if amount is None else float(amount),)], "x double")
    assert df.select(dashboard.format_currency(F.col("x"))).first()[0] == text


def test_tables_as_text(cleaned):
    table = [tuple(r) for r in dashboard.growth_table(cleaned).collect()]
    assert table[:2] == [("2024-01", "$100.00", "N/A"), ("2024-03", "$150.00", "50.0%")]
    cards = {r.title: r.text for r in dashboard.kpi_cards(cleaned).collect()}
    assert cards["Total Revenue"] == "$280.00" and cards["Total Orders"] == "4"


def test_shares_sum_to_the_whole(cleaned):
    assert sum(r.Share_Pct for r in dashboard.revenue_by_category(cleaned).collect()) == pytest.approx(100)


def test_segments_cover_all_customers(sales):
    df = sales(*[{"Customer_ID": f"C{i}", "Revenue": f"{10 * i}.00"} for i in range(1, 9)])
    tiers = {r.Segment: (r.Customers, float(r.Revenue)) for r in dashboard.customer_segmentation(df).collect()}
    assert tiers == {"Low": (2, 30.0), "Medium": (2, 70.0), "High": (2, 110.0), "Top": (2, 150.0)}
