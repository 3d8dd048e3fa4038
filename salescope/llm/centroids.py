"""Centroid clustering of vectors with scalar lookup tables.

Components become integers once. They are stored in blocks of some thousand vectors, and a block
holds, per dimension, the integer values that occur in it and for each vector the number of
its value. Each round tabulates, per dimension, the squared difference of every occurring value
and every centroid; a vector's distances are then gathers from these tables, summed over the
dimensions, and nothing is ever multiplied per vector.

All arithmetic is exact: 64-bit integers inside a task, decimals across tasks, and the driver
divides the sums of ``k`` centroids as Python integers. A task gives one row per centroid. The
centroids, ``k`` times ``dims`` numbers, are all that travels to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.workers import map_batches
from salescope.sources.shared import land

#: Integer steps of one unit, and the largest integer; what lies beyond is set to it, so that
#: the squared distance of 64 dimensions fits in 64 bits.
STEPS, LARGEST = 256, 1 << 27
#: Vectors in one block; their number of a value fits in 16 bits.
BLOCK = 4096

BLOCKS = "ids array<bigint>, counts binary, seen binary, codes binary"
SUMS = "cluster int, sums array<bigint>"
ASSIGNED = "vec_id long, cluster int, distance long"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, within the largest integer."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * STEPS), -LARGEST, LARGEST).astype(np.int64)


def _pack(dims: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            vectors = whole_numbers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
            for low in range(0, len(ids), BLOCK):
                block = vectors[low : low + BLOCK]
                found = [np.unique(block[:, d], return_inverse=True) for d in range(dims)]
                yield pa.record_batch(
                    [
                        pa.array([ids.slice(low, BLOCK).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.array([len(v) for v, _ in found], np.int32).tobytes()], pa.binary()),
                        pa.array([np.concatenate([v for v, _ in found]).astype(np.int32).tobytes()], pa.binary()),
                        pa.array([np.concatenate([c for _, c in found]).astype(np.uint16).tobytes()], pa.binary()),
                    ],
                    names=["ids", "counts", "seen", "codes"],
                )

    return emit


class _Block:
    """Occurring values of each dimension, and the number of each vector's value."""

    def __init__(self, counts: bytes, seen: bytes, codes: bytes):
        edges = np.cumsum(np.frombuffer(counts, np.int32))
        self.seen = np.split(np.frombuffer(seen, np.int32).astype(np.int64), edges[:-1])
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(edges), -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid, of equally near ones the first, and the squared distance."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for seen, codes, centre in zip(self.seen, self.codes, centroids.T, strict=True):
            table = (seen[:, None] - centre[None, :]) ** 2
            total += table[codes]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Per centroid the sum of each dimension, and at the end the number of vectors."""
        of = np.argsort(cluster, kind="stable")
        count = np.bincount(cluster, minlength=k)
        out = np.zeros((k, len(self.seen) + 1), np.int64)
        filled = np.flatnonzero(count)
        at = (np.cumsum(count) - count)[filled]
        for d, (seen, codes) in enumerate(zip(self.seen, self.codes, strict=True)):
            out[filled, d] = np.add.reduceat(seen[codes[of]], at)
        out[:, -1] = count
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, _Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, *rest = (batch.column(c)[k] for c in ("ids", "counts", "seen", "codes"))
            yield ids.as_py(), _Block(*(x.as_py() for x in rest))


def _summed(centroids: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total = np.zeros((k, dims + 1), np.int64)
        for _, block in _blocks(batches):
            total += block.sums(block.nearest(centroids)[0], k)
        filled = np.flatnonzero(total[:, -1])
        yield pa.record_batch(
            [pa.array(filled.astype(np.int32)), pa.array(total[filled].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    return emit


def _assigned(centroids: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            cluster, distance = block.nearest(centroids)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return emit


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least hash, in its order; those of one vec_id by their components."""
    rows = (
        kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "embedding")
        .orderBy("h", "embedding")
        .limit(k)
        .collect()
    )
    return whole_numbers(np.array([r.embedding for r in rows], np.float64))


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    each = sums.select("cluster", F.posexplode("sums").alias("dim", "value"))
    total = each.groupBy("cluster", "dim").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("total")).collect()
    found = {(r.cluster, r.dim): int(r.total) for r in total}
    out = centroids.copy()
    dims = centroids.shape[1]
    for cluster in {c for c, _ in found}:
        out[cluster] = [found[cluster, d] // found[cluster, dims] for d in range(dims)]
    return out


def cluster_vectors(vectors: DataFrame, dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` has vec_id and embedding; other columns are ignored. A vector that is NULL, has not
    ``dims`` components, or one that is NULL or not finite, is left out; so an empty table gives no
    rows. Components beyond ±524288 count as that. Rows with the same vec_id are vectors of their own,
    and a NULL vec_id is hashed as an empty text. With fewer than ``k`` vectors each is a centroid.
    Equal centroids are allowed: vectors go to the first. A sum of distances beyond 64 bits is NULL.
    """
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(f"size(embedding) = {dims} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    centroids = first_centroids(kept, k, seed)
    if len(centroids) == 0:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    blocks = land(map_batches(kept, _pack(dims), BLOCKS), "centroid_blocks")
    for _ in range(rounds):
        centroids = moved(centroids, map_batches(blocks, _summed(centroids), SUMS))
    rows = land(map_batches(blocks, _assigned(centroids), ASSIGNED), "centroid_rows")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in inertia)
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(r.cluster, fits(int(r.s)), fits(total), digest[r.cluster]) for r in inertia],
        "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), F.expr("cluster = _cluster")).drop("_cluster")  # k rows
