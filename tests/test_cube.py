import time
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from salescope.operators import calendar, cube

ROWS = [
    {"Order_ID": "A", "Customer_ID": "1", "Region": "N", "Product_Category": "x", "Revenue": "10.00", "Profit": "1.00"},
    {"Order_ID": "A", "Customer_ID": "1", "Region": "N", "Product_Category": "y", "Revenue": "5.00", "Profit": None},
    {"Order_ID": "A", "Customer_ID": "1", "Region": "N", "Product_Category": "y", "Revenue": "2.50", "Profit": "1.00"},
    {"Order_ID": "B", "Customer_ID": "1", "Region": "S", "Product_Category": "x", "Revenue": "1.00", "Profit": "1.00"},
    {"Order_ID": "C", "Customer_ID": "2", "Region": None, "Product_Category": "x", "Revenue": "0.00", "Profit": "-1.00"},
    {"Order_ID": None, "Customer_ID": "3", "Region": None, "Product_Category": None, "Revenue": "7.00", "Profit": "1.00"},
]
DIMS = ["Region", "Product_Category"]


def brute(rows, dims, sets):
    out = []
    for kept in sets:
        level = sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in kept)
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(r[d] if d in kept else None for d in dims)].append(r)
        if not kept and not rows:
            groups[(None,) * len(dims)] = []
        for key, own in groups.items():
            orders, customers = ({r[c] for r in own} - {None} for c in ("Order_ID", "Customer_ID"))
            money = [sum(float(r[c] or 0) for r in own) for c in ("Revenue", "Profit")]
            out.append((level, *key, *money, len(orders), len(customers), money[0] / len(orders) if orders else 0.0))
    return sorted(out, key=str)


def found(df, dims, sets=None):
    rows = [tuple(r) for r in cube.kpi_cube(df, dims, sets).collect()]
    n = len(dims) + 1
    return sorted(((*r[:n], float(r[n]), float(r[n + 1]), *r[n + 2 :]) for r in rows), key=str)


def test_cube_rollup_and_chosen_sets(sales):
    df = sales(*ROWS)
    cubed = [s for n in (2, 1, 0) for s in combinations(DIMS, n)]
    assert cube.cube_sets(DIMS) == cubed
    assert found(df, DIMS) == brute(ROWS, DIMS, cubed)
    assert cube.rollup_sets(DIMS) == [("Region", "Product_Category"), ("Region",), ()]
    assert found(df, DIMS, cube.rollup_sets(DIMS)) == brute(ROWS, DIMS, cube.rollup_sets(DIMS))
    assert found(df, DIMS, [("Product_Category",)]) == brute(ROWS, DIMS, [("Product_Category",)])


def test_cube_of_an_empty_table(sales):
    empty = sales({}).limit(0)
    assert found(empty, DIMS) == brute([], DIMS, [()])
    assert found(empty, DIMS, [("Region",)]) == []


def test_raw_rows_are_not_repeated_per_grouping_set(sales):
    text = cube.kpi_cube(sales(*ROWS), DIMS)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "NestedLoop" not in text


def test_a_customer_in_many_cells(spark):
    """Repeats among 16 projections of each of 9,000 cells are found without comparing all with all."""
    dims, n = ["Region", "Product_Category", "Sales_Channel", "Product_Name"], 9000
    rows = spark.range(n, numPartitions=1).selectExpr(
        "'A' || id AS Order_ID", "'1' AS Customer_ID", "id % 7 AS Region", "id % 11 AS Product_Category",
        "id % 13 AS Sales_Channel", "'P' || id AS Product_Name", "1.00BD AS Revenue", "0.50BD AS Profit",
    )
    begun = time.monotonic()
    found = cube.kpi_cube(rows, dims).groupBy("level").agg(F.count("*"), F.sum("total_orders"), F.sum("total_customers"))
    cells = {r.level: tuple(r)[1:] for r in found.collect()}
    assert time.monotonic() - begun < 60
    sizes = {0b1111: 1, 0b0111: 7, 0b1011: 11, 0b1101: 13, 0b0011: 77, 0b0101: 91, 0b1001: 143, 0b0001: 1001}
    assert cells == {level: (k, n, k) for level, k in sizes.items()} | {level: (n, n, n) for level in range(0, 16, 2)}


@pytest.mark.parametrize("bad", [1, 2])
def test_cells_of_equal_numbers_get_others(sales, monkeypatch, bad):
    made = cube._hashes

    def some_equal(dims, value, seed):
        equal = F.struct(*[F.lit(7).cast("long").alias(f"_{k}") for k, _ in enumerate(dims)])
        return F.when(seed < bad, equal).otherwise(made(dims, value, seed))

    monkeypatch.setattr(cube, "_hashes", some_equal)
    assert found(sales(*ROWS), DIMS) == brute(ROWS, DIMS, cube.cube_sets(DIMS))
    monkeypatch.setattr(cube, "SEEDS", bad)
    with pytest.raises(Exception, match="cells have equal numbers"):
        cube.kpi_cube(sales(*ROWS), DIMS).collect()


@pytest.fixture
def months(sales):
    def build(*rows):
        df = sales(*[{"Region": region, "Revenue": revenue, "Order_ID": month} for month, region, revenue in rows])
        return df.withColumn("YearMonth", df["Order_ID"])

    return build


def test_frames_do_not_bridge_missing_months(months):
    df = months(
        ("2023-01", "N", "1.00"), ("2023-02", "N", "2.00"), ("2023-12", "N", "4.00"), ("2024-01", "N", "8.00"), ("2024-02", "N", "0.00"),
        ("2025-02", "N", "3.00"), ("2024-01", "S", "5.00"), ("2024-01", None, "9.00"),
    )
    rows = calendar.monthly_frames(df, ["Region"]).orderBy("Region", "YearMonth").collect()
    n = {r.YearMonth: r for r in rows if r.Region == "N"}
    assert len(rows) == 7 and len(n) == 6
    assert [float(n[m].trailing_3) for m in n] == [1, 3, 4, 12, 12, 3] and [n[m].present_3 for m in n] == [1, 2, 1, 2, 3, 1]
    assert [float(n[m].trailing_12) for m in n] == [1, 3, 7, 14, 12, 3]
    assert [float(n[m].year_to_date) for m in n] == [1, 3, 7, 8, 8, 3]
    assert [n[m].month_ago and float(n[m].month_ago) for m in n] == [None, 1, None, 4, 8, None]
    assert [n[m].year_change_pct for m in n] == [None, None, None, 700.0, -100.0, None]  # nothing after zero


def test_ranks_with_ties(months):
    df = months(("2024-01", "a", "4.00"), ("2024-01", "b", "4.00"), ("2024-01", "c", "2.00"), ("2024-02", "c", "0.00"))
    rows = calendar.monthly_ranks(df, "Region", quarters=2).orderBy("YearMonth", "Region").collect()
    assert [(r["rank"], r.dense_rank, r.percent_rank, r.tile) for r in rows] == [(1, 1, 0.0, 1), (1, 1, 0.0, 1), (3, 2, 1.0, 2), (1, 1, 0.0, 1)]
    assert [r.share_pct for r in rows] == [40.0, 40.0, 20.0, None] and [r.running_share_pct for r in rows] == [40.0, 80.0, 100.0, None]
    assert [float(r.behind_best) for r in rows] == [0, 0, 2, 0]
