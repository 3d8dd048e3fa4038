"""What differs between two tables, as multisets of rows.

Rows are hashed, and the hashes of a range of keys add up to a digest that does not depend on order or
partitioning. Only digests are compared at first, so of equal tables no row is shuffled. Ranges that differ are
cut into finer ones in the same way, and only rows of those that still differ meet. Digests are two
sums of 64 bits and a count: two different ranges would pass for equal once in 10^38.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the keys' hash at each level, and levels.
RANGES, LEVELS = 4096, 2


def _hash(columns: Sequence[str], seed: int) -> Column:
    """A hash of the columns that tells NULL from any value, and at which place it is."""
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(seed), missing, *columns)


def _range(level: int) -> Column:
    """The range of a row at a level; each range of the level before has as many as there are in all."""
    return F.pmod(F.shiftright("_key", 12 * level), F.lit(RANGES)).cast("int")


def _digests(rows: DataFrame, level: int, sign: int) -> DataFrame:
    ranges = [_range(k).alias(f"_r{k}") for k in range(level + 1)]
    return rows.groupBy(*ranges).agg(
        (F.count("*") * sign).alias("n"),
        *[F.sum(_hash(rows.columns[1:], seed).cast("decimal(20,0)") * sign).alias(f"h{seed}") for seed in (1, 2)],
    )


def differing_ranges(left: DataFrame, right: DataFrame, level: int) -> DataFrame:
    """Ranges, as columns _r0 to that of ``level``, whose digests differ. Both have _key first."""
    both = _digests(left, level, 1).unionByName(_digests(right, level, -1))
    names = [f"_r{k}" for k in range(level + 1)]
    sums = both.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    return sums.where("n <> 0 OR h1 <> 0 OR h2 <> 0").select(*names)


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that one table has more often: their columns, ``copies`` and ``kind``.

    Both tables have the same columns, in any order; those of ``left`` say which count and how they are
    typed. ``copies`` is how many more ``left`` has, and is negative where ``right`` has more. ``kind`` is
    ``removed`` if only ``left`` has rows left over with the keys, ``added`` if only ``right`` has, and
    ``changed`` if both have. NULL is a value like others, in keys too. Equal tables give no rows.

    The tables are read three times: for the digests of coarse ranges, for those of finer ranges inside
    differing ones, and for the rows of what is left. Ranges are broadcast, of which there are at most
    :data:`RANGES` at first; the join with the finer ones is left to Spark.
    """
    columns = left.columns
    kinds = {f.name: f.dataType for f in left.schema}
    sides = [
        df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).select(_hash(keys, 0).alias("_key"), *columns)
        for df in (left, right)
    ]
    for level in range(LEVELS):
        found = differing_ranges(*sides, level)
        names = found.columns
        wanted = F.broadcast(found) if level == 0 else found
        sides = [
            side.withColumns({f"_r{k}": _range(k) for k in range(level + 1)}).join(wanted, names, "left_semi").drop(*names)
            for side in sides
        ]
    signed = [side.drop("_key").withColumn("copies", F.lit(sign).cast("long")) for side, sign in zip(sides, (1, -1), strict=True)]
    rows = signed[0].unionByName(signed[1]).groupBy(*columns).agg(F.sum("copies").alias("copies")).where("copies <> 0")
    same = Window.partitionBy(*keys)
    lost, new = F.max("copies").over(same) > 0, F.min("copies").over(same) < 0
    kind = F.when(lost & new, "changed").when(lost, "removed").otherwise("added")
    return rows.withColumn("kind", kind)
