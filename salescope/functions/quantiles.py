"""Exact quantiles that no single task has to hold.

``percentile`` and ``median`` keep every distinct value of a column in the buffer
of one final task. Here a first pass only counts rows per logarithmic bucket, a
few thousand rows per column, which tells the buckets the wanted ranks fall in.
Those buckets are split between their own least and greatest value, so
that a column of very close values is spread too. A last pass reads the values of the
parts that are left and counts them per value.

Each pass is one scan. What it finds, two rows per column and rank at most, is a scalar
subquery, which Spark runs once for all places that name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets per doubling of the value; one bucket spans 0.14 % of its values.
BUCKETS_PER_DOUBLING = 512
#: Equal parts of a bucket. If all of 10^12 rows were in one bucket, a part would have 4 million.
PARTS = 1 << 18

# Never falls when the value rises. The shift makes the bucket of every positive
# double positive, as exponents start at -1074. Infinities lie beyond all others.
_BUCKET = f"""
    CASE WHEN value = double('inf') THEN {1 << 22} WHEN value = double('-inf') THEN -{1 << 22}
         WHEN value > 0 THEN floor(log2(value) * {BUCKETS_PER_DOUBLING}) + {1100 * BUCKETS_PER_DOUBLING}
         WHEN value < 0 THEN -floor(log2(-value) * {BUCKETS_PER_DOUBLING}) - {1100 * BUCKETS_PER_DOUBLING}
         ELSE 0 END AS bucket"""


def _sizes(values: DataFrame) -> DataFrame:
    """Rows, least and greatest value of each bucket, with the rows up to it in its parent."""
    return (
        values.groupBy("name", "parent", "bucket")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY name, parent ORDER BY bucket) AS upto")
    )


def _reached(ranks: DataFrame) -> DataFrame:
    """The buckets that the wanted ranks fall in, at most two for each."""
    return ranks.selectExpr(
        "name", "bucket", "low", "high", "prob", "position", "before + upto - n AS before", "before + upto AS _upto"
    ).where("before <= ceil(position) AND floor(position) < _upto").drop("_upto")


def _once(rows: DataFrame) -> DataFrame:
    """Few rows as a table that is made from one scalar subquery."""
    found = rows.agg(F.collect_list(F.struct("*")).alias("rows")).scalar()
    return rows.sparkSession.range(1).select(F.inline(found))


def _split(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of the wanted buckets with the part of it that each falls in."""
    edges = wanted.select("name", F.col("bucket").alias("parent"), "low", "high").distinct()
    part = (
        f"CASE WHEN low < high THEN least({PARTS - 1}, floor((value - low) / (high - low) * {PARTS})) ELSE 0 END"
    )
    return values.drop("parent").withColumnRenamed("bucket", "parent").join(F.broadcast(edges), ["name", "parent"]).selectExpr(
        "name", "value", "parent", f"parent * {PARTS} + {part} AS bucket"
    )


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Quantiles with linear interpolation, as rows of (column, prob, value).

    NULL and NaN are ignored; a column without values gives no rows.
    """
    values = (
        df.select([F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], columns, "name", "value")
        .where("value IS NOT NULL AND NOT isnan(value)")
        .selectExpr("name", "value", "0L AS parent", _BUCKET)
    )
    # At most two rows per column and probability: the broadcasts stay that small.
    wanted = _once(
        _reached(
            _sizes(values)
            .selectExpr("*", "sum(n) OVER (PARTITION BY name) AS total", "0L AS before")
            .selectExpr("*", f"explode(array({', '.join(f'{p}D' for p in probs)})) AS prob")
            .selectExpr("*", "(total - 1) * prob AS position")
        )
    )
    parts = _split(values, wanted)
    ranks = wanted.selectExpr("name", "bucket AS parent", "prob", "position", "before")
    wanted = _once(_reached(_sizes(parts).join(F.broadcast(ranks), ["name", "parent"])))
    counted = (
        parts.drop("parent")
        .join(F.broadcast(wanted.select("name", "bucket").distinct()), ["name", "bucket"], "left_semi")
        .groupBy("name", "bucket", "value")
        .agg(F.count("*").alias("n"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY name, bucket ORDER BY value) AS seen")
    )
    # Each value covers the ranks from the rows before it up to the rows including it.
    ranked = counted.join(F.broadcast(wanted.drop("low", "high")), ["name", "bucket"]).selectExpr(
        "name",
        "prob",
        "position - floor(position) AS part",
        "CASE WHEN before + seen - n <= floor(position) AND floor(position) < before + seen"
        " THEN value END AS low",
        "CASE WHEN before + seen - n <= ceil(position) AND ceil(position) < before + seen"
        " THEN value END AS high",
    )
    between = "CASE WHEN low = high OR part = 0 THEN low ELSE low + (high - low) * part END AS value"
    return (
        ranked.groupBy("name", "prob")
        .agg(*[F.max(c).alias(c) for c in ("low", "high", "part")])
        .selectExpr("name AS column", "prob", between)
    )


def quantile_row(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """The same as one row with an array per column, in the order of ``probs``."""
    found = exact_quantiles(df, columns, probs)

    def values(name: str) -> str:
        parts = (f"max(value) FILTER (WHERE column = '{name}' AND prob = {p}D)" for p in probs)
        return f"array({', '.join(parts)}) AS `{name}`"

    return found.selectExpr(*map(values, columns))
