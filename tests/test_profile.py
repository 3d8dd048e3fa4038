import math
import random

import numpy as np
import pytest

from salescope.functions.quantiles import exact_quantiles
from salescope.operators import profile


def frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def _normal(n):
    draw = random.Random(7)
    return [round(draw.gauss(50, 20), 2) for _ in range(n)]


CASES = {
    "one": [3.0],
    "two": [1.0, 2.0],
    "signs": [-1e9, -2.5, -0.01, 0.0, 0.0, 1e-300, 0.01, 7.0, 1e12],
    "same": [4.2] * 50,
    "hot value": [5.0] * 300 + [float(i) for i in range(600)],
    "gaussian": _normal(2000),
    "outlier": [float(i) for i in range(100)] + [1e15],
    "with null": [1.0, None, 2.0, None, 10.0],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_equal_numpy(spark, name):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    rows = exact_quantiles(frame(spark, CASES[name]).repartition(4), ["x"], probs).collect()
    found = {r.prob: r.value for r in rows}
    values = [v for v in CASES[name] if v is not None]
    for p in probs:
        assert found[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_quantiles_of_an_empty_column(spark):
    assert exact_quantiles(frame(spark, [None, None]), ["x"], [0.5]).count() == 0


@pytest.mark.parametrize("name", ["one", "same", "gaussian", "outlier", "with null"])
def test_histogram_equals_numpy(spark, name):
    rows = sorted(profile.histogram(frame(spark, CASES[name]), "x", 50).collect())
    values = [v for v in CASES[name] if v is not None]
    edges = np.histogram_bin_edges(values, bins=50)
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1].tolist())
    assert sum(r["count"] for r in rows) == len(values)
    if name != "gaussian":  # values on an edge may round to either side
        assert [r["count"] for r in rows] == np.histogram(values, bins=50)[0].tolist()


def test_density_equals_the_sum_over_all_pairs(spark):
    values = np.array(_normal(300))
    rows = sorted(profile.density(frame(spark, values.tolist()).repartition(3), "x").collect())
    x = np.linspace(values.min(), values.max(), 200)
    h = values.std(ddof=1) * len(values) ** -0.2
    kernels = np.exp(-0.5 * ((x[:, None] - values[None, :]) / h) ** 2).sum(axis=1)
    y = kernels / (h * math.sqrt(2 * math.pi)) * (values.max() - values.min()) / 50
    assert [r.x for r in rows] == pytest.approx(x.tolist())
    assert [r.y for r in rows] == pytest.approx(y.tolist())


def test_density_of_a_constant_has_no_points(spark):
    assert profile.density(frame(spark, [1.0, 1.0]), "x").count() == 0


def test_correlations_use_complete_pairs_only(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (None, 1.0, 5.0), (4.0, 7.0, 5.0)],
        "a double, b double, c double",
    )
    cells = {(r.column, r.other): r.correlation for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert cells["a", "b"] == cells["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 7])[0, 1])
    assert cells["a", "a"] == 1.0
    assert cells["c", "c"] is None and cells["a", "c"] is None


def test_describe_equals_numpy(spark):
    values = _normal(500)
    row = profile.describe(frame(spark, values)).first()
    assert row.column == "x" and row["count"] == 500
    assert row.mean == pytest.approx(np.mean(values))
    assert row.std == pytest.approx(np.std(values, ddof=1))
    assert [row.min, row.q25, row.q50, row.q75, row.max] == pytest.approx(
        np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist()
    )


def test_describe_of_dates(spark):
    df = spark.sql("SELECT explode(array(date'1970-01-02', date'1970-01-04')) AS d")
    row = profile.describe(df).first()
    assert (row["count"], row.mean, row.std, row.q50) == (2, 2.0, None, 2.0)


def test_missing_and_distinct_values(sales):
    df = sales({"Region": None, "Profit": None}, {"Region": None}, {"Region": "North"})
    report = {r.column: (r.missing_count, r.missing_pct) for r in profile.missing_report(df).collect()}
    assert report == {"Region": (2, 66.67), "Profit": (1, 33.33)}
    assert profile.any_missing(df).first().any_missing
    unique = {r.column: r.n_unique for r in profile.nunique_per_column(df).collect()}
    assert unique["Region"] == 1 and unique["Order_ID"] == 1 and len(unique) == 13
    assert {r.n_unique for r in profile.nunique_per_column(df.limit(0)).collect()} == {0}


def test_shape_info_and_head(sales):
    df = sales(*[{"Order_ID": f"O{i}"} for i in range(20)])
    assert tuple(profile.row_count(df).first()) == (20, 13)
    assert [r.Order_ID for r in profile.head(df.repartition(6), 3).collect()] == ["O0", "O1", "O2"]
    info = {r.column: (r.dtype, r.non_null) for r in profile.column_info(df).collect()}
    assert info["Quantity"] == ("int", 20)


def test_margin_of_zero_revenue_is_missing(sales):
    df = profile.profit_margin(sales({"Revenue": "0.00"}, {"Revenue": "20.00", "Profit": "5.00"}))
    assert sorted(r.Profit_Margin or 0 for r in df.collect()) == [0, 25.0]


def test_customer_means_are_per_row(sales):
    df = sales({"Revenue": "10.00"}, {"Revenue": "20.00"}, {"Order_ID": "B", "Revenue": "60.00"})
    row = profile.customer_stats(df).first()
    assert (float(row.Total_Revenue), row.Order_Count, row.Avg_Order_Value) == (90.0, 2, 30.0)


def test_nan_is_missing_like_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x DOUBLE")
    assert profile.missing_series(df).first().missing_count == 2
    assert profile.column_info(df).first().non_null == 2
    assert profile.nunique_per_column(df).first().n_unique == 2
    row = profile.describe(df).first()
    assert (row["count"], row.mean, row.q50, row.max) == (2, 2.0, 2.0, 3.0)


def test_quantiles_of_infinities_and_of_close_values(spark):
    from salescope.functions.quantiles import exact_quantiles

    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (float("nan"),)], "x DOUBLE")
    assert exact_quantiles(ends, ["x"], [0.0, 0.5, 1.0]).orderBy("prob").collect()[1].value == 1.0
    close = spark.range(100_001).selectExpr("1000D + id / 200000D AS x")  # one bucket holds all
    assert exact_quantiles(close, ["x"], [0.5]).first().value == 1000.25


def test_close_values_are_spread_over_windows(spark):
    from salescope.functions import quantiles

    close = spark.range(100_000).selectExpr("'x' AS name", "1000D + id / 200000D AS value", "0L AS bucket")
    edges = spark.sql("SELECT 'x' AS name, 0L AS bucket, 1000D AS low, 1000.5D AS high")
    largest = quantiles._split(close, edges).groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert largest < 20


def test_binned_density_is_within_its_bound(spark, sf_dir):
    from salescope.plans.fixtures import sales_clean

    df = sales_clean(spark, sf_dir)
    for column in ("Revenue", "Profit"):
        exact = {r.point: r.y for r in profile.density(df, column).collect()}
        count = df.where(f"{column} IS NOT NULL").count()
        stats = df.selectExpr(f"(max({column}) - min({column})) / 50 AS w", f"stddev_samp(CAST({column} AS DOUBLE)) AS s").first()
        height = count * float(stats.w) / (stats.s * count**-0.2 * (2 * 3.141592653589793) ** 0.5)
        for cells in (4, 16):
            rows = profile.density_binned(df, column, per_bandwidth=cells).collect()
            assert len(rows) == 200
            assert max(abs(r.y - exact[r.point]) for r in rows) <= height / (8 * cells**2)


def test_binned_density_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,)], "v double")
    assert profile.density_binned(df, "v").count() == 0
    two = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    rows = {r.point: r.y for r in profile.density_binned(two, "v", per_bandwidth=64).collect()}
    assert rows == pytest.approx({r.point: r.y for r in profile.density(two, "v").collect()}, rel=1e-3)
    assert profile.density_binned(df.limit(0), "v").count() == 0
