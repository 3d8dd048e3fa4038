"""Mixing sources to target weights by weighted sampling without replacement.

Sources share a budget of words by weight; no source gets more than twice its size.
A source first gives all its documents as often as whole epochs fit. The rest is filled
with a sample: each document has the key ``-ln(u) / quality`` with u from its id, keys
are taken from the lowest up (exponential keys scaled by quality, sorted), and prefix
sums of words tell where the budget ends.

A source may hold any share of the rows, so no window runs over a source. Keys are mapped to
the unit interval by x / (1 + x), which spreads them whatever the quality, and
counted in 1,024 equal buckets. Prefix sums over those find the bucket that the
budget ends in, and that bucket alone is split again. What is left for a window
is the rows of one bucket in about a million; where all rows have the least quality, the
later half of them still has 60,000 buckets. The result of the search is one
cut per source, a small table; each document compares its own key with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.sources.shared import land

# The word pattern, the weights in turn, the budget and the ceiling.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
CEILING = 2

SEED = 20_240_517
BUCKETS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """Each row as struct ``_row`` with its doc_id, source, words and place in the draw.

    ``place`` is the sampling key; lower ones are taken first. Quality is
    the share of a text's characters that are no symbols, digits or capitals, at least
    0.05; an empty text has the least. The random part hashes the id alone, so
    reruns and other partitionings draw alike.
    """
    text = "coalesce(_row.text, '')"
    rows = docs.select(F.struct("*").alias("_row")).selectExpr(
        "_row",
        "_row.doc_id AS doc_id",
        "_row.source AS source",
        f"CAST(size(regexp_extract_all({text}, r'{WORD}', 0)) AS BIGINT) AS size",
        rf"greatest(0.05D, char_length(regexp_replace({text}, r'[\x21-\x5A]', ''))"
        f" / greatest(char_length({text}), 1)) AS quality",
        f"(shiftrightunsigned(xxhash64(doc_id, {SEED}L), 11) + 0.5D) / 9007199254740992D AS _u",
    )
    return rows.selectExpr("* EXCEPT (_u)", "-ln(_u) / quality AS place")


def targets(rows: DataFrame) -> DataFrame:
    """Words that each source is to give: source, source_size, weight, target.

    The excess of sources above the ceiling is shared again by weight until none is
    above. That ends where every source gets the lesser of its ceiling and one common
    level times its weight; sorted by ceiling over weight, prefix sums tell that level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1
    )
    sources = (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .selectExpr("*", f"CAST({CEILING} * source_size AS DOUBLE) AS ceiling")
    )
    filled = sources.selectExpr(
        "*",
        "coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, weight, source"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below",
        "sum(weight) OVER (ORDER BY ceiling / weight, weight, source"
        " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above",
        f"{BUDGET_SHARE} * sum(source_size) OVER () AS budget",
    )
    # The level is right for the first source whose own ceiling it does not reach.
    levels = filled.selectExpr("*", "(budget - below) / above AS level").selectExpr(
        "*", "min(CASE WHEN level * weight <= ceiling THEN struct(ceiling / weight, level) END) OVER () AS stop"
    )
    return levels.selectExpr(
        "source",
        "source_size",
        "weight",
        "least(ceiling, coalesce(stop.level * weight, ceiling)) AS target",
    )


def _cut_bucket(rows: DataFrame, need: DataFrame, bucket: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the bucket that each source's rest ends in, and what is left to fill in it."""
    rows = rows.withColumn("_bucket", F.expr(bucket))
    sums = (
        rows.groupBy("source", "_bucket")
        .agg(F.sum("size").alias("n"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY source ORDER BY _bucket) AS upto")
        .alias("s")
        .join(need.alias("t"), F.expr("s.source <=> t.source"))
        .where("upto >= rest AND upto - n < rest")
        .selectExpr("s.source AS source", "_bucket", "rest - (upto - n) AS rest")
    )
    cut = land(sums, "mixing_buckets")
    inside = rows.alias("r").join(
        cut.alias("c"), F.expr("r.source <=> c.source AND r._bucket = c._bucket"), "left_semi"
    )
    return inside.drop("_bucket"), cut.drop("_bucket")


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: its target, whole epochs, and the last place that is taken.

    ``cut_place`` and ``cut_id`` are NULL where no part of an epoch is taken. Rows with
    equal id and place go together. The last one is taken if that comes nearer.
    """
    goals = goals.selectExpr(
        "*", "CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS epochs"
    ).selectExpr("*", "target - epochs * source_size AS rest")
    need = goals.where("rest > 0").select("source", "rest")
    slim = rows.where("size > 0").select("source", "doc_id", "size", "place")
    inside, need = _cut_bucket(slim, need, f"CAST(floor(place / (1 + place) * {BUCKETS}) AS INT)")
    inside, need = _cut_bucket(
        inside, need, f"CAST(floor(place / (1 + place) * {BUCKETS * BUCKETS}) AS BIGINT)"
    )
    ends = (
        inside.groupBy("source", "place", "doc_id")
        .agg(F.sum("size").alias("n"))
        .selectExpr("*", "sum(n) OVER (PARTITION BY source ORDER BY place, doc_id) AS upto")
        .alias("r")
        .join(need.alias("t"), F.expr("r.source <=> t.source"))
        .selectExpr(
            "r.source AS source",
            "rest",
            "place",
            "doc_id",
            "upto",
            "upto <= rest OR upto - rest < rest - (upto - n) AS taken",
        )
        .groupBy("source")
        .agg(
            F.expr("max(struct(place, doc_id)) FILTER (WHERE taken)").alias("last"),
            F.expr("min(struct(place, doc_id))").alias("first"),
        )
    )
    return (
        goals.alias("g")
        .join(ends.alias("e"), F.expr("g.source <=> e.source"), "left")
        .selectExpr(
            "g.source AS source",
            "source_size",
            "target",
            "epochs",
            "coalesce(last.place, first.place) AS cut_place",
            "last.doc_id AS cut_id",
            "last IS NULL AS before_cut",
        )
    )


def mix(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` as ``_row`` with size, source_size, target, copies and taken.

    ``rows`` may hold the same rows as landed by a caller that has no use for texts.
    NULL text has size 0; a row of size 0 goes along with whole epochs only. NULL source
    is a source of its own and the last. Rows that repeat are drawn together. Other
    columns, whatever their names, pass through in ``_row``. An empty table gives no rows.
    """
    rows = sized(docs) if rows is None else rows
    slim = land(rows.select("source", "doc_id", "size", "place"), "mixing_sizes")
    limits = land(cuts(slim, targets(slim)), "mixing_cuts").withColumnRenamed("source", "_source")
    partly = F.expr(
        "size > 0 AND cut_place IS NOT NULL AND (place < cut_place OR NOT before_cut AND place = cut_place"
        " AND doc_id <= cut_id)"
    )
    return (
        rows.join(limits, F.expr("source <=> _source"))
        .withColumn("copies", F.col("epochs") + F.coalesce(partly, F.lit(False)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "before_cut")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as it is taken."""
    taken = mix(docs).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")
