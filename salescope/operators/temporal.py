"""Joins on time: the last known value, and points or periods within periods.

None of them compares all rows of a key. An as-of join orders both sides together and carries values
forward; a key's rows are cut into blocks of time, each block is ordered on its own, and only
its last value is passed on to later blocks. A join with periods cuts these at bin edges and meets
in equal bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that the time of an as-of join is cut into.
BLOCKS = 256
#: A period is cut at the edges of its level's bins; from level to level these are so many times as
#: long, and a period takes the first level at which it has so many bins at most.
WIDER, LEVELS = 64, 5


def _clock(time: str) -> Column:
    """Microseconds of a date or timestamp."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    columns: list[str],
    direction: str = "backward",
    strict: bool = False,
    tolerance: str | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` that was the last of its key at the time.

    Times are dates or timestamps. ``backward`` takes the last row at or before the left one's time,
    ``forward`` the first at or after it; ``strict`` leaves out equal times. With a ``tolerance``
    (an interval such as ``30 days``) a row that is farther away does not count. Every left row is
    there once, with NULLs where nothing is found; so are those without a key or time. Of right rows
    with equal key and time the greatest by ``columns``, in that order, counts. Columns that both
    sides have must be renamed first, but for ``by``.

    Both sides are shuffled once, by key and block of time, so a key with a third of all rows is
    split in up to :data:`BLOCKS` tasks. The last value of each block is carried over the blocks of a
    key, at most that many rows.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is {direction!r}")
    back = direction == "backward"
    value = F.struct(F.col(right_time).alias("_at"), *[F.col(c).alias(c) for c in columns])
    known = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by).alias("_key"), _clock(right_time).alias("_time"), value.alias("_value")
    )
    asked = left.select(F.col(by).alias("_key"), _clock(left_time).alias("_time"), F.struct("*").alias("_row"))
    none = F.col("_key").isNull() | F.col("_time").isNull()
    nothing = F.lit(None).cast(known.schema["_value"].dataType)

    ends = known.agg(F.struct(F.min("_time").alias("low"), F.max("_time").alias("high")).alias("e")).scalar()
    side = asked.where(~none).withColumn("_value", nothing).unionByName(
        known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    )
    # Rows outside the time of the right side are in a block beyond its first or last one.
    place = f"CAST(least({BLOCKS}, greatest(-1, (_time - _ends.low) DIV greatest((_ends.high - _ends.low) DIV {BLOCKS} + 1, 1L))) AS INT)"
    before = f"CASE WHEN _time < _ends.low THEN -1 ELSE {place} END"
    rows = side.withColumn("_ends", ends).withColumn("_block", F.expr(before)).drop("_ends")

    def order(time: str) -> Column:
        return F.col(time).asc() if back else F.col(time).desc()

    # Of equal times, right rows come first unless they are left out. A greater value comes later.
    first = F.col("_row").isNull() if strict else F.col("_row").isNotNull()
    inside = Window.partitionBy("_key", "_block").orderBy(order("_time"), first, F.col("_value").asc_nulls_first())
    held = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(held)).where("_row IS NOT NULL")

    best = F.struct(F.when(F.lit(back), F.col("_time")).otherwise(-F.col("_time")).alias("t"), "_value")
    # Only right rows have a value, and a block of left rows is just named: no left row is sorted for this.
    at = ["_key", "_block"]
    ended = rows.where("_row IS NULL").groupBy(*at).agg(F.max(best).alias("_last"))
    asking = rows.where("_row IS NOT NULL").select(*at).distinct().withColumn("_last", F.lit(None).cast(ended.schema["_last"].dataType))
    last = ended.unionByName(asking).groupBy(*at).agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_key", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    found = near.drop("_value").join(carried, ["_key", "_block"], "left").select(
        "_row", F.coalesce("_near", F.col("_carried._value")).alias("_value")
    )
    alone = asked.where(none).select("_row", nothing.alias("_value"))
    joined = found.unionByName(alone).select("_row.*", F.col("_value"))
    if tolerance is not None:
        a, b = (F.col(left_time), F.col("_value._at")) if back else (F.col("_value._at"), F.col(left_time))
        near_enough = a.cast("timestamp") <= b.cast("timestamp") + F.expr(f"INTERVAL {tolerance}")
        joined = joined.withColumn("_value", F.when(near_enough, F.col("_value")))
    kept = [F.col(f"`{c}`") for c in left.columns]
    return joined.select(*kept, F.col("_value._at").alias(right_time), *[F.col(f"_value.`{c}`").alias(c) for c in columns])


def _widths(width: int) -> list[int]:
    """Bin widths of the levels, within 64 bits."""
    return [min(width * WIDER**k, 1 << 61) for k in range(LEVELS)]


def _levels(length: str, width: int) -> str:
    """The level of a period of that length: its bins are then at most ``WIDER`` and one."""
    cases = " ".join(f"WHEN {length} <= {w}L THEN {k}" for k, w in enumerate(_widths(width)[1:]))
    return f"CASE {cases} ELSE {LEVELS - 1} END"


def _width(level: str, width: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {w}L" for k, w in enumerate(_widths(width)))
    return f"(CASE {level} {cases} END)"


def _floor(value: str, width: str) -> str:
    return f"(({value}) - pmod({value}, {width})) DIV {width}"


_UNITS = {"seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


def _micros(length: str) -> int:
    count, unit = length.split()
    return int(count) * _UNITS[unit if unit.endswith("s") else unit + "s"]


def interval_join(
    points: DataFrame, periods: DataFrame, by: str, point: str, start: str, end: str, bin_width: str = "1 day", closed: bool = False
) -> DataFrame:
    """All pairs of a point and a period of its key with ``start <= point < end`` (``<=`` if closed).

    Times are dates or timestamps. A NULL start or end is open. Rows without a key, points without a time
    and empty periods are in no pair. Columns that both sides have must be renamed first, but for ``by``.

    A period goes to every bin that it touches, and a point to the one it is in, so each pair meets
    once. Long periods are cut into longer bins (see :data:`WIDER`), so none has many; points are
    repeated for the levels that occur only. Let the bin be about as long as a short period.
    """
    width = _micros(bin_width)
    here = points.where(F.col(by).isNotNull() & F.col(point).isNotNull()).withColumn("_t", _clock(point))
    ends = here.agg(F.struct(F.min("_t").alias("low"), F.max("_t").alias("high")).alias("e")).scalar()
    last = "_high" if closed else "_high - 1"
    cut = (
        periods.where(F.col(by).isNotNull())
        .withColumnRenamed(by, "_by")
        .withColumn("_ends", ends)
        # Only the part of a period in which there are points is cut.
        .withColumn("_from", F.greatest(F.coalesce(_clock(start), F.col("_ends.low")), F.col("_ends.low")))
        .withColumn("_high", F.coalesce(_clock(end), F.col("_ends.high") + 1))
        .withColumn("_to", F.least(F.expr(last), F.col("_ends.high")))
        .where("_from <= _to")
        .withColumn("_level", F.expr(_levels("_to - _from", width)))
    )
    size = _width("_level", width)
    levels = cut.agg(F.collect_set("_level").alias("l")).scalar()
    binned = cut.withColumn("_bin", F.explode(F.expr(f"sequence({_floor('_from', size)}, {_floor('_to', size)})")))
    dealt = here.withColumn("_level_of", F.explode(levels)).withColumn("_bin_of", F.expr(_floor("_t", _width("_level_of", width))))
    meet = (F.col(by) == F.col("_by")) & (F.col("_level_of") == F.col("_level")) & (F.col("_bin_of") == F.col("_bin"))
    pairs = dealt.join(binned, meet & (F.col("_t") >= F.col("_from")) & (F.col("_t") <= F.col("_to")))
    return pairs.select(*points.columns, *[c for c in periods.columns if c != by])


def overlap_join(a: DataFrame, b: DataFrame, by: str, a_period: tuple[str, str], b_period: tuple[str, str], bin_width: str = "1 day") -> DataFrame:
    """All pairs of periods of a key that have time in common; a period's end is not part of it.

    Times are dates or timestamps. Rows without a key, start or end and empty periods are in no pair. Columns
    that both sides have must be renamed first, but for ``by``.

    Both sides go to every bin that they touch at the longer one's level, and a pair is taken in the
    bin where its common time begins, so once.
    """
    width = _micros(bin_width)

    def cut(df: DataFrame, period: tuple[str, str], mark: str) -> DataFrame:
        low, high = f"_{mark}_low", f"_{mark}_high"
        return (
            df.withColumns({low: _clock(period[0]), high: _clock(period[1]), f"_{mark}_by": F.col(by)})
            .where(F.col(by).isNotNull() & (F.col(low) < F.col(high)))
            .withColumn(f"_{mark}_level", F.expr(_levels(f"{high} - {low}", width)))
        )

    left, right = cut(a, a_period, "a"), cut(b, b_period, "b").drop(by)
    levels = [side.agg(F.collect_set(f"_{m}_level").alias("l")).scalar() for side, m in ((left, "a"), (right, "b"))]

    def binned(df: DataFrame, mark: str, others: Column) -> DataFrame:
        # Levels not below its own: there it is one of the shorter ones, and has few bins.
        own, size = f"_{mark}_level", _width(f"_{mark}_at", width)
        at = df.withColumn("_others", others).withColumn(
            f"_{mark}_at", F.explode(F.expr(f"array_distinct(concat(array({own}), filter(_others, x -> x > {own})))"))
        )
        bins = f"sequence({_floor(f'_{mark}_low', size)}, {_floor(f'_{mark}_high - 1', size)})"
        return at.drop("_others").withColumn(f"_{mark}_bin", F.explode(F.expr(bins)))

    left, right = binned(left, "a", levels[1]), binned(right, "b", levels[0])
    meet = (F.col("_a_by") == F.col("_b_by")) & (F.col("_a_at") == F.col("_b_at")) & (F.col("_a_bin") == F.col("_b_bin"))
    pairs = left.join(right, meet & (F.col("_a_low") < F.col("_b_high")) & (F.col("_b_low") < F.col("_a_high")))
    begin = _floor("greatest(_a_low, _b_low)", _width("_a_at", width))
    once = pairs.where(f"_a_at = greatest(_a_level, _b_level) AND _a_bin = {begin}")
    return once.select(*a.columns, *[c for c in b.columns if c != by])
