import hashlib
import math
import random

import numpy as np
import pytest

from salescope.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, sums string, ids string"


def brute(rows, k=40, rounds=5):
    """Rows of the result by plain comparison, with Python's integers."""
    kept = [
        (i, [min(max(math.floor(256 * x) if abs(x) < 1e9 else x, -(1 << 27)), 1 << 27) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept = [(i, [int(x) for x in v]) for i, v in kept]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in set(of):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            centres[n] = [sum(d) // len(own) for d in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    total, digest = sum(d for d, _ in last), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, d, sum(e for e, m in last if m == n), total, digest[n]) for (i, _), (d, n) in zip(kept, last, strict=True)]


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 1, "x", "x") for i, v in rows], VECTORS)
    return [tuple(r) for r in centroids.cluster_vectors(df).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.fixture(scope="module")
def vectors():
    chosen = random.Random(4)
    # A 16th is exact as a float, so ties are frequent.
    return [(i, [chosen.randrange(-4, 5) / 16 + (i % 7) / 4 for _ in range(64)]) for i in range(180)]


def test_matches_plain_comparison(spark, vectors, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    assert sorted(found(spark, vectors)) == sorted(brute(vectors))


def test_hard_rows(spark, vectors):
    one = vectors[0][1]
    rows = [
        *vectors[:60], *vectors[:5], (None, one), (None, vectors[3][1]), (900, None), (901, []), (902, one[:63]), (903, [*one, 1.0]),
        (904, [None, *one[1:]]), (905, [math.nan, *one[1:]]), (906, [math.inf, *one[1:]]), (907, [0.0] * 64), (908, [-0.0] * 64),
        (909, [3e38] + [0.0] * 63), (910, [-3e38] * 64), (7, one), (7, vectors[9][1]),
    ]
    assert in_order(found(spark, rows)) == in_order(brute(rows))


def test_fewer_vectors_than_centroids_and_equal_ones(spark, vectors):
    rows = [(i, vectors[0][1]) for i in range(3)] + [(5, vectors[1][1])]
    assert sorted(found(spark, rows)) == sorted(brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [1.0])]])
def test_no_vectors(spark, rows):
    assert found(spark, rows) == []


def test_tables_give_the_squared_distances():
    chosen = np.random.Generator(np.random.PCG64(1))
    block, centres = chosen.integers(-300, 300, (50, 64)), chosen.integers(-300, 300, (6, 64))
    parts = [np.unique(block[:, d], return_inverse=True) for d in range(64)]
    packed = centroids._Block(
        np.array([len(v) for v, _ in parts], np.int32).tobytes(),
        np.concatenate([v for v, _ in parts]).astype(np.int32).tobytes(),
        np.concatenate([c for _, c in parts]).astype(np.uint16).tobytes(),
    )
    plain = ((block[:, None] - centres[None]) ** 2).sum(axis=2)
    cluster, distance = packed.nearest(centres)
    assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
