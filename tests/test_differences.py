import random
from collections import Counter

import pytest

from salescope.operators import differences

SCHEMA = "k string, a int, b string"


def brute(left, right):
    off = Counter(left)
    off.subtract(Counter(right))
    off = {row: n for row, n in off.items() if n}
    out = []
    for row, n in off.items():
        own = [m for r, m in off.items() if r[0] == row[0]]
        kind = "changed" if max(own) > 0 > min(own) else "removed" if max(own) > 0 else "added"
        out.append((*row, n, kind))
    return sorted(out, key=str)


def found(spark, left, right):
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).select("b", "a", "k")
    return sorted((tuple(r) for r in differences.differences(a, b, ["k"]).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    chosen = random.Random(1)
    return [(chosen.choice([None, *(f"k{i}" for i in range(300))]), chosen.choice([None, 1, 2]), chosen.choice([None, "x", "1"])) for _ in range(900)]


@pytest.mark.parametrize("ranges", [4, 4096])
def test_every_planted_change_is_listed(spark, rows, monkeypatch, ranges):
    monkeypatch.setattr(differences, "RANGES", ranges)
    other = [*rows[10:], rows[20], rows[20], ("new", 1, "x"), (None, None, None)]
    other[40] = (other[40][0], 7, other[40][2])
    other[50] = (other[50][0], None, None)
    random.Random(2).shuffle(other)
    assert found(spark, rows, other) == brute(rows, other)


def test_equal_tables_in_another_order(spark, rows):
    other = list(rows)
    random.Random(3).shuffle(other)
    assert found(spark, rows, other) == []
    assert found(spark, [], []) == []
    assert found(spark, rows[:3], []) == brute(rows[:3], [])


def test_null_at_another_place_differs(spark):
    a = spark.createDataFrame([("k", None, "1")], "k string, a string, b string")
    b = spark.createDataFrame([("k", "1", None)], "k string, a string, b string")
    assert {(r.a, r.b, r.copies, r.kind) for r in differences.differences(a, b, ["k"]).collect()} == {
        (None, "1", 1, "changed"), ("1", None, -1, "changed")
    }


def test_only_ranges_that_differ_are_read_further(spark, rows):
    def keyed(values):
        return spark.createDataFrame(values, SCHEMA).select(differences._hash(["k"], 0).alias("_key"), "*")

    a, b = keyed(rows), keyed([*rows[1:], (rows[0][0], 9, "y")])
    for level in (0, 1):
        assert differences.differing_ranges(a, keyed(rows[::-1]), level).count() == 0
        assert differences.differing_ranges(a, b, level).count() == 1
