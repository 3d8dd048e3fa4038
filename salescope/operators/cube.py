"""Key figures for every combination of dimensions, with exact distinct counts.

Counting distinct orders per grouping set the plain way repeats every row once per set and shuffles all of
those. Here rows are repeated never. Sums are taken per cell, the finest combination, and only
cells are rolled up. For distinct counts, each order (or customer) becomes the set of cells that it
occurs in; equal sets are counted, and each different set is projected on the grouping sets once,
with its count.

Cells stand as numbers there, a hash per dimension, so that a projection is an exclusive or and repeats are
found at the cost of a look-up. The numbers of all projected cells are checked to differ before they
are used, and made with another seed if they do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.operators.kpi import average_order, total

#: Distinct counts, by the column that is counted.
DISTINCT = {"total_orders": "Order_ID", "total_customers": "Customer_ID"}
#: How often numbers that are not all different are made anew.
SEEDS = 4


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of the dimensions, the finest first."""
    return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """The dimensions, then without the last one, and so on to none."""
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def _level(dims: Sequence[str], kept: Sequence[str]) -> int:
    """A bit for each dimension that is summed over, the first dimension's the highest."""
    return sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in kept)


def _projections(dims: dict[str, str], sets: Sequence[tuple[str, ...]], cell: Column) -> Column:
    """The cell in each grouping set: its level and the dimensions, NULL where summed over."""
    return F.array(
        *[
            F.struct(
                F.lit(_level(list(dims), kept)).alias("level"),
                *[(cell[d] if d in kept else F.lit(None).cast(kind)).alias(d) for d, kind in dims.items()],
            )
            for kept in sets
        ]
    )


def _hashes(dims: Sequence[str], value: Callable[[str], Column], seed: Column) -> Column:
    """A number per dimension, for its value; that of NULL differs between dimensions too."""
    return F.struct(*[F.xxhash64(seed, F.lit(k), value(d)).alias(f"_{k}") for k, d in enumerate(dims)])


def _number(dims: Sequence[str], kept: tuple[str, ...], hashes: Column) -> Column:
    """The number of a projected cell, from those of the kept dimensions and its level."""
    level = F.xxhash64(F.lit("level"), F.lit(_level(dims, kept)))
    return reduce(Column.bitwiseXOR, [hashes[f"_{k}"] for k, d in enumerate(dims) if d in kept], level)


def _number_at(dims: Sequence[str], seed: Column) -> Column:
    """The number of the projected cell ``at``, as :func:`_number` makes it."""
    level, hashes = F.col("at.level"), _hashes(dims, lambda d: F.col("at")[d], seed)
    kept = [F.when(level.bitwiseAND(_level(dims, [e for e in dims if e != d])) == 0, hashes[f"_{k}"]) for k, d in enumerate(dims)]
    return reduce(Column.bitwiseXOR, [k.otherwise(F.lit(0).cast("long")) for k in kept], F.xxhash64(F.lit("level"), level))


def _seed(found: DataFrame, dims: Sequence[str]) -> Column:
    """The first seed by which all projected cells have numbers of their own.

    Their amounts come along unused: so Spark reuses the sums per cell and reads the rows once for both.
    """
    tried = [F.struct(F.lit(s).alias("seed"), _number_at(dims, F.lit(s)).alias("number")) for s in range(SEEDS)]
    money = ["total_revenue", "total_profit"]
    cells = found.select(F.explode(F.array(*tried)).alias("t"), *money).groupBy("t.seed", "t.number")
    alike = cells.agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in money])
    alike = alike.groupBy("seed").agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in money])
    first = F.min(F.when(F.col("n") == 1, F.col("seed")))
    failed = F.raise_error(F.lit(f"cells have equal numbers by each of {SEEDS} seeds")).cast("int")
    seed = F.when(F.count("*") == 0, 0).otherwise(F.coalesce(first, failed))
    return alike.agg(F.struct(seed.alias("seed"), *[F.max(c) for c in money]).alias("s")).scalar()["seed"]


def kpi_cube(df: DataFrame, dims: Sequence[str], sets: Sequence[tuple[str, ...]] | None = None) -> DataFrame:
    """Revenue, profit, distinct orders and customers, and the average order, per grouping set.

    ``sets`` are subsets of ``dims``: :func:`cube_sets` by default, or :func:`rollup_sets`, or any others. ``level``
    has a bit for each dimension that is summed over, so a NULL of the data is told from a total. An empty
    table gives no rows, but for the grand total if that is among the sets.
    """
    sets = list(sets if sets is not None else cube_sets(dims))
    kinds, cell = {d: df.schema[d].dataType.simpleString() for d in dims}, F.struct(*dims)
    sums = df.groupBy(*dims).agg(F.sum("Revenue").alias("revenue"), F.sum("Profit").alias("profit"))
    parts = sums.select(F.explode(_projections(kinds, sets, cell)).alias("at"), "revenue", "profit")
    if () in sets:  # a row of nothing, so that the grand total is there without rows too
        kind = parts.schema["at"].dataType.simpleString()
        grand = F.struct(F.lit(_level(dims, ())), *[F.lit(None).cast(k) for k in kinds.values()]).cast(kind)
        nothing = [F.lit(0).cast(parts.schema[c].dataType).alias(c) for c in parts.columns[1:]]
        parts = parts.unionByName(df.sparkSession.range(1).select(grand.alias("at"), *nothing))
    found = parts.groupBy("at").agg(total("revenue").alias("total_revenue"), total("profit").alias("total_profit"))
    # Attached as a column first, so that a plan holds the subquery once.
    seed, seeded = _seed(found, dims), F.col("_seed")
    found = found.withColumn("_seed", seed).withColumn("_number", _number_at(dims, seeded))
    counts = None
    for name, column in DISTINCT.items():
        # Sets of cells are combined inside tasks; what is shuffled is a set per value and task.
        rows = df.where(F.col(column).isNotNull()).withColumn("_seed", seed).select(column, _hashes(dims, F.col, seeded).alias("cell"))
        each = rows.groupBy(column).agg(F.sort_array(F.collect_set("cell")).alias("cells"))
        alike = each.groupBy("cells").agg(F.count("*").alias("n"))
        # A value counts once in a projected cell, in however many cells of that it occurs.
        per_set = [F.array_distinct(F.transform("cells", partial(_number, dims, kept))) for kept in sets]
        own = alike.select(
            F.explode(F.concat(*per_set)).alias("_number"),
            *[(F.col("n") if other == name else F.lit(0).cast("long")).alias(other) for other in DISTINCT],
        )
        counts = own if counts is None else counts.unionByName(own)
    counts = counts.groupBy("_number").agg(*[F.sum(name).alias(name) for name in DISTINCT])
    rows = found.join(counts, "_number", "left").select(
        "at.*", "total_revenue", "total_profit", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in DISTINCT]
    )
    return rows.withColumn("average_order_value", average_order(F.col("total_revenue"), F.col("total_orders")))
