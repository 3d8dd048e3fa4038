import random
from datetime import datetime, timedelta

import pytest

from salescope.operators import temporal

START = datetime(2024, 1, 1)
LEFT, RIGHT = "id int, k string, t timestamp, x int", "k string, at timestamp, v int, w string"


def moment(hours):
    return None if hours is None else START + timedelta(hours=hours)


def brute(left, right, back=True, strict=False, within=None):
    out = []
    for i, k, t, _ in left:
        best = None
        for key, at, v, w in right:
            if k is None or key != k or t is None or at is None:
                continue
            away = t - at if back else at - t
            if away < 0 or (strict and away == 0) or (within is not None and away > within):
                continue
            value = (-away, (v is not None, v), (w is not None, w))
            if best is None or value > best[0]:
                best = value, (at, v, w)
        out.append((i, *(best[1] if best else (None,) * 3)))
    return sorted(out)


def found(spark, left, right, **options):
    a = spark.createDataFrame([(i, k, moment(t), x) for i, k, t, x in left], LEFT)
    b = spark.createDataFrame([(k, moment(t), v, w) for k, t, v, w in right], RIGHT)
    rows = temporal.asof_join(a, b, "k", "t", "at", ["v", "w"], **options)
    assert rows.columns == ["id", "k", "t", "x", "at", "v", "w"]
    return sorted((r.id, None if r.at is None else round((r.at - START).total_seconds() / 3600), r.v, r.w) for r in rows.collect())


@pytest.fixture(scope="module")
def sides():
    chosen = random.Random(1)
    keys = ["a"] * 6 + ["b", "c", None]  # one key has two thirds
    left = [(i, chosen.choice([*keys, "only left"]), chosen.choice([None, *range(-60, 260)]), i) for i in range(400)]
    right = [
        (chosen.choice([*keys, "only right"]), chosen.choice([None, *range(0, 200, 3)]), chosen.choice([None, 1, 2]), chosen.choice("xyz"))
        for _ in range(150)
    ]
    return left, right


@pytest.mark.parametrize("blocks", [1, 7, 256])
@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_brute_force(spark, sides, monkeypatch, blocks, back, strict):
    monkeypatch.setattr(temporal, "BLOCKS", blocks)
    direction = "backward" if back else "forward"
    assert found(spark, *sides, direction=direction, strict=strict) == brute(*sides, back, strict)


def test_asof_tolerance(spark, sides):
    for back in (True, False):
        direction = "backward" if back else "forward"
        assert found(spark, *sides, direction=direction, tolerance="5 hours") == brute(*sides, back, within=5)


def test_asof_with_an_empty_side(spark, sides):
    left, right = sides
    assert found(spark, left, []) == brute(left, [])
    assert found(spark, [], right) == []
    assert found(spark, left, [("a", 5, 1, "x")] * 3) == brute(left, [("a", 5, 1, "x")])
    with pytest.raises(ValueError, match="sideways"):
        found(spark, left, right, direction="sideways")


@pytest.fixture(scope="module")
def periods():
    chosen = random.Random(2)
    out = []
    for i in range(160):
        low = chosen.choice([None, *range(-40, 300)])
        length = chosen.choice([0, 1, 2, 3, 30, 2000, -4])
        high = None if low is None or chosen.random() < 0.1 else low + length
        out.append((i, chosen.choice(["a", "a", "a", "b", None]), low, high))
    return out


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("width", ["1 hour", "2 days"])
def test_interval_join_matches_brute_force(spark, periods, monkeypatch, closed, width):
    monkeypatch.setattr(temporal, "WIDER", 8)
    chosen = random.Random(3)
    points = [(i, chosen.choice(["a", "a", "b", "z", None]), chosen.choice([None, *range(-30, 310)])) for i in range(300)]
    a = spark.createDataFrame([(i, k, moment(t)) for i, k, t in points], "id int, k string, t timestamp")
    b = spark.createDataFrame([(i, k, moment(s), moment(e)) for i, k, s, e in periods], "p int, k string, s timestamp, e timestamp")
    rows = temporal.interval_join(a, b, "k", "t", "s", "e", width, closed)
    assert rows.columns == ["id", "k", "t", "p", "s", "e"]
    plain = [
        (i, p)
        for i, k, t in points
        for p, key, s, e in periods
        if k is not None and k == key and t is not None and (s is None or s <= t) and (e is None or t < e or (closed and t == e))
    ]
    assert sorted((r.id, r.p) for r in rows.collect()) == sorted(plain) and plain


def test_overlap_join_matches_brute_force(spark, periods, monkeypatch):
    monkeypatch.setattr(temporal, "WIDER", 8)
    a = spark.createDataFrame([(i, k, moment(s), moment(e)) for i, k, s, e in periods], "p int, k string, s timestamp, e timestamp")
    b = a.selectExpr("p AS q", "k", "s AS s2", "e AS e2").where("p % 3 = 0")
    rows = temporal.overlap_join(a, b, "k", ("s", "e"), ("s2", "e2"), "3 hours")
    full = [p for p in periods if None not in p and p[2] < p[3]]
    plain = [(x[0], y[0]) for x in full for y in full if y[0] % 3 == 0 and x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    assert sorted((r.p, r.q) for r in rows.collect()) == sorted(plain) and plain


def test_interval_joins_of_empty_tables(spark):
    a = spark.createDataFrame([], "id int, k string, t timestamp")
    b = spark.createDataFrame([(1, "a", START, None)], "p int, k string, s timestamp, e timestamp")
    assert temporal.interval_join(a, b, "k", "t", "s", "e").count() == 0
    points = spark.createDataFrame([(1, "a", START)], "id int, k string, t timestamp")
    assert temporal.interval_join(points, b.limit(0), "k", "t", "s", "e").count() == 0
    assert temporal.interval_join(points, b, "k", "t", "s", "e").count() == 1


def test_joins_on_time_compare_equal_keys_only(spark, sf_dir):
    from salescope.plans.queries import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("asof_exchange_rate", "interval_join_promotions", "overlap_join_promotions"):
            text = registry()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
