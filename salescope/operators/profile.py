"""Data profiling: shape, missing values, distributions, correlations, rankings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions.quantiles import exact_quantiles
from salescope.functions.values import nan_to_null, ratio
from salescope.operators.kpi import grouped, top_selling_products, total
from salescope.schema import SEQ

# Settings of the profile that the results depend on.
HISTOGRAM_BINS = 50
DENSITY_POINTS = 200
DENSITY_CELLS = 16
CORRELATED = ["Quantity", "Unit_Price", "Discount", "Revenue", "Profit"]
QUARTILES = [0.25, 0.5, 0.75]


#: Points that one row of the density computation contributes to.
_BLOCK = 25


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != SEQ]


def _with_nulls(df: DataFrame) -> DataFrame:
    """NaN as NULL, as both are missing values in a profile."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def _long(row: DataFrame, fields: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One wide row of aggregates as one row per entry of ``fields``."""
    entries = [
        F.struct(F.lit(name).alias(key), *[value.alias(field) for field, value in values.items()])
        for name, values in fields.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(_visible(df))))


def head(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in input order."""
    return df.orderBy(*(order or [SEQ])).limit(n).select(_visible(df))


def column_info(df: DataFrame) -> DataFrame:
    """Name, type and number of values of each column."""
    names = _visible(df)
    kinds = dict(df.dtypes)
    row = _with_nulls(df).agg(*[F.count(c).alias(c) for c in names])
    return _long(row, {c: {"dtype": F.lit(kinds[c]), "non_null": F.col(c)} for c in names})


def nunique_per_column(df: DataFrame) -> DataFrame:
    """Distinct values of every column, NULL not counted.

    Values are keyed by (column, value), so that the shuffle spreads them however
    few columns there are.
    """
    names = _visible(df)
    values = _with_nulls(df).select([F.col(c).cast("string").alias(c) for c in names])
    found = (
        values.unpivot([], names, "column", "value")
        .where("value IS NOT NULL")
        .groupBy("column")
        .agg(F.count_distinct("value").alias("n"))
    )
    # One row per column on both sides.
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("column"))
    return every.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n_unique")
    )


def missing_series(df: DataFrame) -> DataFrame:
    """Missing values per column, as a count and in percent with two decimals."""
    names = _visible(df)
    row = _with_nulls(df).agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in names])
    missing = {c: F.col("_rows") - F.col(c) for c in names}
    return _long(
        row,
        {
            c: {"missing_count": n, "missing_pct": F.round(ratio(n, F.col("_rows")) * 100, 2)}
            for c, n in missing.items()
        },
    )


def missing_report(df: DataFrame) -> DataFrame:
    """The columns that miss something."""
    return missing_series(df).where("missing_count > 0")


def any_missing(df: DataFrame) -> DataFrame:
    """One row telling whether any value is missing."""
    return missing_series(df).agg((F.sum("missing_count") > 0).alias("any_missing"))


def _epoch_days(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per column.

    Covers numbers and dates. A date is given in days since 1970-01-01 and has no
    deviation. The deviation is that of a sample; quartiles are exact, interpolated
    linearly and computed without collecting a column in one task.
    """
    kinds = {f.name: f.dataType for f in df.schema if f.name != SEQ}
    dates = [c for c, kind in kinds.items() if isinstance(kind, T.DateType)]
    numbers = [c for c, kind in kinds.items() if isinstance(kind, T.NumericType)]
    names = dates + numbers
    values = _with_nulls(df).select([_epoch_days(c).alias(c) for c in dates] + numbers)
    moments = values.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                ratio(F.sum(c), F.count(c)).alias("mean"),
                (
                    F.stddev_samp(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")
                ).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in names
        ]
    ).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.*") for c in names])))
    quartiles = (
        exact_quantiles(values, names, QUARTILES)
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{p * 100:.0f}")
                for p in QUARTILES
            ]
        )
    )
    # Both sides have one row per column.
    return moments.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the value range; the last bin includes the maximum.

    Gives every bin with its edges, the empty ones too. The range around a single
    value is widened by a half on both sides.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    low, high = F.min("value"), F.max("value")
    margin = F.when(low == high, 0.5).otherwise(0.0)
    span = values.select(
        F.struct(
            (low - margin).alias("low"), ((high + margin - (low - margin)) / bins).alias("width")
        )
    ).scalar()
    # The range is attached as a column, so that the plan holds the subquery once.
    counts = (
        values.withColumn("span", span)
        .groupBy(F.expr(f"least(floor((value - span.low) / span.width), {bins - 1})").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"), span.alias("span"))
    # No more rows than bins on either side.
    return every_bin.join(F.broadcast(counts), "bin", "left").selectExpr(
        "bin",
        "span.low + bin * span.width AS bin_start",
        "span.low + (bin + 1) * span.width AS bin_end",
        "coalesce(n, 0) AS count",
    )


def _curve(weighted: DataFrame, points: int) -> DataFrame:
    """The sum of kernels at all points, from rows of value, w and s, the settings of the curve."""
    block = min(_BLOCK, points)
    kernels = ", ".join(
        f"sum(w * exp(-0.5D * pow((s.low + (first + {offset}) * s.step - value) / s.bandwidth, 2)))"
        for offset in range(block)
    )
    sums = (
        weighted.where("s.bandwidth > 0")
        .selectExpr("*", f"explode(sequence(0, {points - 1}, {block})) AS first")
        .groupBy("first", "s")
        .agg(F.expr(f"array({kernels})").alias("kernels"))
    )
    # Scaling from density to counts: n rows times the width of a bin.
    return (
        sums.selectExpr("first", "s", "posexplode(kernels) AS (offset, kernel)")
        .selectExpr("first + offset AS point", "s", "kernel")
        .where(F.col("point") < points)
        .selectExpr(
            "point",
            "s.low + point * s.step AS x",
            "kernel * s.bin_width / (s.bandwidth * sqrt(2 * pi())) AS y",
        )
    )


def _curve_settings(values: DataFrame, points: int, bins: int) -> Column:
    return values.selectExpr(
        f"""struct(min(value) AS low, (max(value) - min(value)) / {points - 1} AS step,
            (max(value) - min(value)) / {bins} AS bin_width,
            stddev_samp(value) * pow(count(value), -0.2D) AS bandwidth)"""
    ).scalar()


def density(
    df: DataFrame, column: str, points: int = DENSITY_POINTS, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Gaussian density of a column, scaled to the counts of its histogram.

    The bandwidth follows Scott's rule, the points run from the smallest to the
    largest value. Equal values are counted first, so the work is one kernel per
    distinct value and point. A row adds to the points of one block at a time, and each
    task adds up its share of all points before the shuffle.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    counted = values.groupBy("value").agg(F.count("*").alias("w"))
    return _curve(counted.withColumn("s", _curve_settings(values, points, bins)), points)


def density_binned(
    df: DataFrame,
    column: str,
    points: int = DENSITY_POINTS,
    bins: int = HISTOGRAM_BINS,
    per_bandwidth: int = DENSITY_CELLS,
) -> DataFrame:
    """The same curve from values on a grid of ``per_bandwidth`` cells per bandwidth.

    Every value is shared between the two ends of its cell, by its distance from them. A kernel is then
    off by 1 / (8 * per_bandwidth ** 2) of its height at most, so by 0.05 % for 16 cells, and so is
    the curve, measured by its height if all values were equal. The work is a kernel per used end and point:
    it follows the range of the values in bandwidths, not how many of them there are.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    placed = values.withColumn("s", _curve_settings(values, points, bins)).where("s.bandwidth > 0")
    cells = (
        placed.selectExpr("s", f"(value - s.low) * {per_bandwidth} / s.bandwidth AS at")
        .groupBy("s", F.floor("at").alias("cell"))
        .agg(F.count("*").alias("n"), F.sum(F.expr("at - floor(at)")).alias("right"))
    )
    ends = cells.selectExpr("s", "stack(2, cell, n - right, cell + 1, right) AS (cell, w)").groupBy("s", "cell").agg(F.sum("w").alias("w"))
    return _curve(ends.selectExpr("s", f"s.low + cell * s.bandwidth / {per_bandwidth} AS value", "w"), points)


def profit_margin(df: DataFrame) -> DataFrame:
    """Adds the profit in percent of the revenue, with two decimals."""
    margin = F.round(ratio(F.col("Profit"), F.col("Revenue")) * 100, 2)
    return df.withColumn("Profit_Margin", margin)


def revenue_by_region(df: DataFrame) -> DataFrame:
    return grouped(df, "Region", Revenue=total("Revenue")).orderBy(F.desc("Revenue"), "Region")


def profit_by_category(df: DataFrame) -> DataFrame:
    return grouped(df, "Product_Category", Profit=total("Profit")).orderBy(
        "Profit", "Product_Category"
    )


def revenue_by_channel(df: DataFrame) -> DataFrame:
    return grouped(df, "Sales_Channel", Revenue=total("Revenue")).orderBy(
        "Revenue", "Sales_Channel"
    )


def top10_products(df: DataFrame) -> DataFrame:
    return top_selling_products(df, 10)


def customer_stats(df: DataFrame, n: int | None = None) -> DataFrame:
    """Revenue, orders and mean revenue per row of each customer, by revenue."""
    ranked = grouped(
        df,
        "Customer_ID",
        Total_Revenue=total("Revenue"),
        Order_Count=F.count_distinct("Order_ID"),
        Avg_Order_Value=ratio(F.sum("Revenue"), F.count("Revenue")),
    ).orderBy(F.desc("Total_Revenue"), "Customer_ID")
    return ranked if n is None else ranked.limit(n)


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the complete pairs; NULL if one side never varies.

    ``corr`` itself stops with a division by zero in that case.
    """
    both = a.isNotNull() & b.isNotNull()
    spreads = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spreads)


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair of columns, as (column, other, correlation).

    One scan. Each pair uses the rows that have both values.
    """
    pairs = list(combinations(columns, 2))
    numbers = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(
        *[_correlation(numbers[a], numbers[b]).alias(f"{a}|{b}") for a, b in pairs],
        # A column correlates with itself unless it never varies.
        *[F.when(F.min(c) < F.max(c), F.lit(1.0)).alias(f"{c}|{c}") for c in columns],
    )
    cells = {(a, b): f"{a}|{b}" for a, b in pairs} | {(c, c): f"{c}|{c}" for c in columns}
    cells |= {(b, a): f"{a}|{b}" for a, b in pairs}
    entries = [
        F.struct(
            F.lit(a).alias("column"), F.lit(b).alias("other"), F.col(f"`{name}`").alias("correlation")
        )
        for (a, b), name in cells.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def correlation_with_revenue(df: DataFrame) -> DataFrame:
    """The correlations with revenue, strongest positive first."""
    return (
        correlation_matrix(df)
        .where(F.col("other") == "Revenue")
        .select("column", "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "column")
    )
