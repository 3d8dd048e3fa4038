"""Months that stand out, and forecasts with a season, per segment.

Both start from one row per segment and month, so everything below is small per segment and
spread over segments. Medians and folds run inside Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.values import ratio
from salescope.operators.kpi import grouped, total

#: Months of a season, and months before and after one that its level is the median of.
SEASON, AROUND = 12, 6
#: Passes over trend and season.
PASSES = 2
#: What makes the median distance of normal values their standard deviation.
NORMAL = 1.4826
#: A month stands out from this score on.
LIMIT = 3.5
#: Weights of the newest value in level, trend and season that a forecast tries.
GRID = tuple((a, b, c) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for c in (0.1, 0.4))

_MONTH = "CAST(substr(YearMonth, 1, 4) AS INT) * 12 + CAST(substr(YearMonth, 6, 2) AS INT) - 1"


def _monthly(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    rows = grouped(df, ["YearMonth", *by], value=total(value))
    return rows.select(*by, "YearMonth", F.expr(_MONTH).alias("month"), F.col("value").cast("double").alias("value"))


def decompose(df: DataFrame, by: Sequence[str], value: str = "Revenue", passes: int = PASSES) -> DataFrame:
    """Per segment and month: value, trend, season and what remains.

    The trend is the median of the months around, within six either way by the calendar, of the value less the
    season; the season is the median, over all years, of the value less the trend. They are taken in
    turns, so that one odd month moves neither. Months without rows are left out of the medians.
    """
    rows = _monthly(df, by, value).withColumn("season", F.lit(0.0))
    around = Window.partitionBy(*by).orderBy("month").rangeBetween(-AROUND, AROUND)
    same = Window.partitionBy(*by, F.expr(f"pmod(month, {SEASON})"))
    for _ in range(passes):
        rows = rows.withColumn("trend", F.percentile(F.col("value") - F.col("season"), 0.5).over(around))
        rows = rows.withColumn("season", F.percentile(F.col("value") - F.col("trend"), 0.5).over(same))
    return rows.withColumn("rest", F.col("value") - F.col("trend") - F.col("season"))


def anomalies(df: DataFrame, by: Sequence[str], value: str = "Revenue", limit: float = LIMIT, passes: int = PASSES) -> DataFrame:
    """The decomposition with a score per month, and whether the month stands out.

    The score is the distance of what remains from its segment's median, in standard deviations as the
    median distance gives them. Where that is zero, as more than half of the months have the same rest,
    a month has no score and does not stand out.
    """
    segment = Window.partitionBy(*by)
    rows = decompose(df, by, value, passes).withColumn("_off", F.col("rest") - F.percentile("rest", 0.5).over(segment))
    spread = F.percentile(F.abs("_off"), 0.5).over(segment) * NORMAL
    rows = rows.withColumn("score", ratio(F.col("_off"), spread))
    outside = F.coalesce(F.abs("score") > limit, F.lit(False))
    return rows.withColumn("stands_out", outside).drop("_off", "month").withColumnRenamed("value", value)


def _series(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per segment the values of all months, from the first to the last of any segment; 0 where there is none."""
    rows = _monthly(df, by, value)
    ends = rows.agg(F.struct(F.min("month").alias("low"), F.max("month").alias("high")).alias("e")).scalar()
    found = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("_found"))
    return found.withColumn("_ends", ends).selectExpr(
        *by,
        "_ends.high AS last",
        "transform(sequence(_ends.low, _ends.high), m -> coalesce(_found[m], 0D)) AS values",
    )


def smoothed(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per segment of ``by``, last and values: the weights of least error, and level, trend and season after the last month.

    Additive exponential smoothing, folded over the values for all weights of :data:`GRID`. Level and season
    start from the first year, the trend from nothing. The error is the sum of squares of what each
    month differs from its forecast the month before, from the second year on; of equal errors the
    first weights count. ``season`` begins with the month that comes next. Fewer than two years give no row.
    """
    grid = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abc", w, strict=True)]) for w in GRID])
    started = (
        series.where(f"size(values) >= {2 * SEASON}")
        .selectExpr("*", f"aggregate(slice(values, 1, {SEASON}), 0D, (s, x) -> s + x) / {SEASON} AS _level")
        .selectExpr("*", f"transform(slice(values, 1, {SEASON}), x -> x - _level) AS _season")
        .select("*", F.posexplode(grid).alias("_nth", "w"))
    )
    # The new level is needed three times, so it is bound as the one element of an array.
    step = f"""transform(array(w.a * (x - s.season[0]) + (1 - w.a) * (s.level + s.trend)), l -> named_struct(
        'level', l,
        'trend', w.b * (l - s.level) + (1 - w.b) * s.trend,
        'season', concat(slice(s.season, 2, {SEASON - 1}), array(w.c * (x - l) + (1 - w.c) * s.season[0])),
        'error', s.error + CASE WHEN s.n < {SEASON} THEN 0D ELSE pow(x - s.level - s.trend - s.season[0], 2) END,
        'n', s.n + 1))[0]"""
    start = "named_struct('level', _level, 'trend', 0D, 'season', _season, 'error', 0D, 'n', 0)"
    folded = started.withColumn("s", F.expr(f"aggregate(values, {start}, (s, x) -> {step})"))
    best = F.min_by(F.struct("w", "s", "last"), F.struct("s.error", "_nth"))
    return folded.groupBy(*by).agg(best.alias("r")).select(*by, "r.last", "r.w.*", "r.s.level", "r.s.trend", "r.s.season", "r.s.error")


def seasonal_forecast(df: DataFrame, by: Sequence[str], periods: int = 12, value: str = "Revenue") -> DataFrame:
    """Per segment and coming month: the forecast by level, trend and season, and the weights a, b, c."""
    fitted = smoothed(_series(df, by, value), by)
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return ahead.selectExpr(
        *by,
        "step",
        "format_string('%04d-%02d', (last + step) div 12, pmod(last + step, 12) + 1) AS YearMonth",
        f"level + step * trend + season[pmod(step - 1, {SEASON})] AS forecast",
        "a",
        "b",
        "c",
    )


def holdout_rating(df: DataFrame, by: Sequence[str], months: int = 6, value: str = "Revenue") -> DataFrame:
    """Errors of forecasts for the last months from those before, beside the same month of the year before.

    Rows of model, n, rmse and mae, over all segments.
    """
    series = _series(df, by, value)
    known = series.withColumns({"last": F.col("last") - months, "values": F.expr(f"slice(values, 1, greatest(size(values) - {months}, 0))")})
    fitted = smoothed(known, by).drop("last")
    renamed = fitted.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    both = series.join(renamed, same) if by else series.crossJoin(renamed)  # one row each
    tried = both.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months)))).selectExpr(
        f"values[size(values) - {months} + step - 1] AS actual",
        f"level + step * trend + season[pmod(step - 1, {SEASON})] AS smoothing",
        f"values[size(values) - {months} + step - 1 - {SEASON}] AS year_before",
    )
    errors = tried.selectExpr("stack(2, 'smoothing', smoothing - actual, 'year_before', year_before - actual) AS (model, off)")
    return errors.groupBy("model").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"), F.avg(F.abs("off")).alias("mae")
    )
