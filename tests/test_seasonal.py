import math
import random

import numpy as np
import pytest

from salescope.operators import seasonal, sketches


@pytest.fixture
def monthly(sales):
    """Makes sales of values per month and region; a month is a number since 2020-01."""

    def build(values):
        rows = [{"Region": region, "Revenue": f"{v:.2f}", "Order_ID": f"{2020 + m // 12}-{m % 12 + 1:02d}"} for region, m, v in values]
        df = sales(*rows)
        return df.withColumn("YearMonth", df["Order_ID"])

    return build


def normal_months(region, count, seed):
    chosen = random.Random(seed)
    return [(region, m, 1000 + 5 * m + 100 * math.sin(m * math.pi / 6) + chosen.uniform(-20, 20)) for m in range(count)]


def test_planted_months_stand_out_and_others_do_not(monthly):
    values = normal_months("N", 60, 1) + normal_months("S", 48, 2)
    planted = {("N", 17): 600, ("N", 40): -500, ("S", 30): 400}
    values = [(r, m, v + planted.get((r, m), 0)) for r, m, v in values if (r, m) != ("S", 20)]  # and one is missing
    rows = seasonal.anomalies(monthly(values), ["Region"], limit=8).collect()
    assert len(rows) == 107
    found = {(r.Region, (int(r.YearMonth[:4]) - 2020) * 12 + int(r.YearMonth[5:]) - 1) for r in rows if r.stands_out}
    assert found == set(planted)
    for r in rows:
        assert r.Revenue == pytest.approx(r.trend + r.season + r.rest)


def test_equal_months_have_no_score(monthly):
    rows = seasonal.anomalies(monthly([("N", m, 5.0) for m in range(30)]), ["Region"]).collect()
    assert all(r.score is None and not r.stands_out for r in rows)
    assert seasonal.anomalies(monthly([("N", 0, 1.0)]).limit(0), ["Region"]).count() == 0


def recursion(values, a, b, c):
    level, trend = np.mean(values[:12]), 0.0
    season, error = [x - level for x in values[:12]], 0.0
    for i, x in enumerate(values):
        if i >= 12:
            error += (x - level - trend - season[i % 12]) ** 2
        new = a * (x - season[i % 12]) + (1 - a) * (level + trend)
        trend, level = b * (new - level) + (1 - b) * trend, new
        season[i % 12] = c * (x - new) + (1 - c) * season[i % 12]
    return level, trend, season, error


def test_forecast_equals_the_plain_recursion(monthly):
    values = normal_months("N", 50, 3) + [v for v in normal_months("S", 50, 4) if v[1] not in (20, 21)]
    rows = seasonal.seasonal_forecast(monthly(values), ["Region"], 14).orderBy("Region", "step").collect()
    assert len(rows) == 28 and rows[0].YearMonth == "2024-03" and rows[13].YearMonth == "2025-04"
    for region in "NS":
        series = [round(dict((m, v) for r, m, v in values if r == region).get(m, 0.0), 2) for m in range(50)]
        tried = [(recursion(series, *w), w) for w in seasonal.GRID]
        (level, trend, season, _), weights = min(tried, key=lambda t: t[0][3])
        for r in (r for r in rows if r.Region == region):
            assert (r.a, r.b, r.c) == weights
            assert r.forecast == pytest.approx(level + r.step * trend + season[(49 + r.step) % 12])


def test_holdout_rates_the_last_months_only(monthly):
    values = normal_months("N", 50, 5)
    rated = {r.model: r for r in seasonal.holdout_rating(monthly(values), ["Region"], 6).collect()}
    series = [round(v, 2) for _, _, v in values]
    (level, trend, season, _), _ = min(((recursion(series[:44], *w), w) for w in seasonal.GRID), key=lambda t: t[0][3])
    off = [level + h * trend + season[(43 + h) % 12] - series[43 + h] for h in range(1, 7)]
    old = [series[43 + h - 12] - series[43 + h] for h in range(1, 7)]
    for model, errors in (("smoothing", off), ("year_before", old)):
        assert rated[model].n == 6
        assert rated[model].rmse == pytest.approx(float(np.sqrt(np.mean(np.square(errors)))))
        assert rated[model].mae == pytest.approx(float(np.mean(np.abs(errors))))


def test_too_few_months_give_no_forecast(monthly):
    assert seasonal.seasonal_forecast(monthly(normal_months("N", 23, 1)), ["Region"]).count() == 0
    assert seasonal.seasonal_forecast(monthly([("N", 0, 1.0)]).limit(0), ["Region"]).count() == 0


@pytest.fixture(scope="module")
def amounts(spark):
    chosen = random.Random(6)
    rows = [
        (chosen.choice("abc"), chosen.choice([None, f"k{int(chosen.paretovariate(0.3)) % 9000}"]), chosen.choice([None, round(chosen.lognormvariate(3, 3), 4), -round(chosen.random(), 4), 0.0]))
        for _ in range(20_000)
    ]
    return spark.createDataFrame(rows, "g string, key string, x double").repartition(7)


def test_united_sketches_equal_the_sketch_of_all(amounts):
    parts = [amounts.where(f"abs(hash(key, x)) % 3 = {k}") for k in range(3)]
    for sketch, unite, column in (
        (sketches.distinct_sketch, sketches.unite_distinct, "key"),
        (sketches.quantile_sketch, sketches.unite_quantiles, "x"),
    ):
        whole = sketch(amounts, [], [column])
        stored = [sketch(p, ["g"], [column]) for p in parts]
        united = unite(stored[0].unionByName(stored[1]).unionByName(stored[2]))
        assert sorted(map(tuple, united.collect())) == sorted(map(tuple, whole.select(united.columns).collect()))


def test_estimates_are_within_the_stated_errors(spark, amounts):
    for count in (0, 1, 50, 3000, 200_000):
        ids = spark.range(count).selectExpr("CAST(id AS STRING) AS id")
        rows = sketches.estimate_distinct(sketches.distinct_sketch(ids, [], ["id"])).collect()
        assert (rows[0].estimate if rows else 0) == pytest.approx(count, rel=0.065)  # four standard errors
    values = sorted(r.x for r in amounts.where("x IS NOT NULL").collect())
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for r in sketches.estimate_quantiles(sketches.quantile_sketch(amounts, [], ["x"]), probs).collect():
        true = values[max(math.ceil(r.prob * len(values)), 1) - 1]
        assert r.estimate == pytest.approx(true, rel=0.004, abs=0.0001)


def test_buckets_rise_with_amounts_and_middles_are_near(spark):
    steps = sorted({s * (n + d) for s in (-1, 1) for k in range(0, 58) for n in (1 << k,) for d in (0, 1, n // 3, n // 2)})
    df = spark.createDataFrame([(n,) for n in steps], "n long").selectExpr("n", f"{sketches._bucket('n')} AS b")
    rows = df.selectExpr("n", "b", f"{sketches._middle('b')} AS middle").orderBy("n").collect()
    assert all(x.b <= y.b for x, y in zip(rows[:-1], rows[1:], strict=True))
    assert all(abs(r.middle - r.n) <= abs(r.n) / 256 for r in rows)
