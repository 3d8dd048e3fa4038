"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few whole-number rates. A mergeable quantile sketch counts, per
language, source and rate, the rows in each of some hundred buckets of bounded relative
width; sketches of two groups or partitions merge by adding counts. Rates beyond the
upper fence of their own group's sketch reject a document, so a corpus of tables or of
capitals is judged by its own habits and not by a fixed cutoff.

Only built-in functions are used. Nothing is joined by document, so texts never move:
the fences are a small table that is written once and joined by language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.sources.shared import land

# Patterns of words and symbols, and the limits of the base rule.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Rates per thousand, with the least distance of a fence from the median. It keeps a
#: group in which nearly all documents have the same rate from rejecting small deviations.
RATES = {"symbols": 300, "dup_lines": 500, "repeats": 300, "capitals": 250}
#: A fence lies this many interquartile ranges above the upper quartile.
FENCE_RANGES = 3
#: Groups with fewer documents use the sketch of their whole language.
LEAST_GROUP = 200

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bucket(rate: str) -> str:
    """Lower edge of a rate's bucket: exact to 128, then 64 buckets per doubling."""
    steps = " ".join(
        f"WHEN {rate} < {128 << k} THEN shiftleft(shiftright({rate}, {k}), {k})" for k in range(1, 24)
    )
    return f"CASE WHEN {rate} < 128 THEN {rate} {steps} ELSE {128 << 23} END"


def measure(docs: DataFrame) -> DataFrame:
    """Each row as struct ``_row`` with its base measures, its rates and ``base_failed``.

    NULL text counts as empty. Words of all three-word windows that occur more than
    once in a text are counted once each in ``n_repeat_words``: windows are sorted by
    fingerprint, those equal to a neighbour are kept, and their union is measured.
    """
    text = F.coalesce("_row.text", F.lit(""))
    words = docs.select(F.struct("*").alias("_row")).select(
        "_row",
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    windows = words.selectExpr(
        "_row",
        "_lines",
        "CAST(size(_words) AS BIGINT) AS n_words",
        "CAST(char_length(array_join(_words, '')) AS BIGINT) AS word_chars",
        f"CAST(char_length(_text) - char_length(regexp_replace(_text, r'{SYMBOL}', '')) AS BIGINT) AS n_symbols",
        r"CAST(char_length(_text) - char_length(regexp_replace(_text, r'\p{Lu}', '')) AS BIGINT) AS n_capitals",
        "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT) AS n_dup_lines",
        "CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3),"
        " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END AS _windows",
    )
    ordered = windows.selectExpr(
        "* EXCEPT (_windows)",
        "CASE WHEN size(array_distinct(_windows)) < size(_windows)"
        " THEN sort_array(transform(_windows, (w, i) -> struct(w, i))) END AS _sorted",
    )
    repeated = ordered.selectExpr(
        "* EXCEPT (_sorted)",
        "sort_array(transform(filter(_sorted, (s, i) ->"
        " s.w <=> get(_sorted, i - 1).w OR s.w <=> get(_sorted, i + 1).w), s -> s.i)) AS _starts",
    )
    measured = repeated.selectExpr(
        "* EXCEPT (_starts)",
        "CAST(coalesce(aggregate(transform(_starts, (s, i) -> least(3, coalesce(get(_starts, i + 1) - s, 3))),"
        " 0, (a, x) -> a + x), 0) AS BIGINT) AS n_repeat_words",
    )
    return measured.selectExpr(
        "_row",
        *MEASURES,
        "1000 * n_symbols div greatest(n_words, 1) AS symbols",
        "1000 * n_dup_lines div greatest(size(_lines), 1) AS dup_lines",
        "1000 * n_repeat_words div greatest(n_words, 1) AS repeats",
        "1000 * n_capitals div greatest(word_chars, 1) AS capitals",
        f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed",
    )


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per language, source, rate and bucket. Partial counts merge by addition."""
    rates = ", ".join(f"'{r}', {_bucket(r)}" for r in RATES)
    return (
        rows.selectExpr("lang", "source", f"stack({len(RATES)}, {rates}) AS (rate, bucket)")
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    by = ", ".join([*keys, "rate"])
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.selectExpr(
        "*",
        f"sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto",
        f"sum(n) OVER (PARTITION BY {by}) AS total",
    )
    quartiles = ranked.groupBy(*keys, "rate").agg(
        *[F.expr(f"min(bucket) FILTER (WHERE 4 * upto >= {q} * total)").alias(f"q{q}") for q in (1, 2, 3)],
        F.max("total").alias("total"),
    )
    least = " ".join(f"WHEN '{r}' THEN {n}" for r, n in RATES.items())
    return quartiles.selectExpr(
        *keys,
        "rate",
        "total",
        f"greatest(q3 + {FENCE_RANGES} * (q3 - q1), q2 + CASE rate {least} END) AS fence",
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Upper fences, one row per language and source with one column per rate."""
    own = _fences(sketch, ["lang", "source"]).alias("own")
    whole = _fences(sketch, ["lang"]).alias("whole")
    chosen = own.join(
        whole, F.expr("own.lang <=> whole.lang AND own.rate = whole.rate")
    ).selectExpr(
        "own.lang AS lang",
        "own.source AS source",
        "own.rate AS rate",
        f"CASE WHEN own.total >= {LEAST_GROUP} THEN own.fence ELSE whole.fence END AS fence",
    )
    return chosen.groupBy("lang", "source").agg(
        *[F.expr(f"max(fence) FILTER (WHERE rate = '{r}')").alias(f"{r}_fence") for r in RATES]
    )


def verdict(rows: DataFrame, limits: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Adds the group's fences and ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    passed = F.expr(" AND ".join(f"{r} <= {r}_fence" for r in RATES))
    return (
        rows.join(limits, F.col("_lang").eqNullSafe(lang) & F.col("_source").eqNullSafe(source))
        .drop("_lang", "_source")
        .withColumn("kept", ~F.col("base_failed") & passed)
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: measures, rates, its group's fences, ``base_failed`` and ``kept``.

    ``docs`` has doc_id, text, lang and source; other columns, whatever their names, are
    ignored. NULL language or source is a group of its own. Rows that repeat are judged
    one by one. An empty table gives no rows.
    """
    rows = measure(docs).selectExpr("_row.doc_id", "_row.lang", "_row.source", "* EXCEPT (_row)")
    rows = land(rows, "quality_measures")
    limits = land(fences(sketches(rows)), "quality_fences")
    return verdict(rows, limits, F.col("lang"), F.col("source"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Measures are taken twice, once for the sketches and once for the verdict, which is
    cheaper than moving or storing the texts. Rows go by an array that is empty for
    rejected ones: a filter would be pushed below the steps of the measures, and those be
    repeated in it many times over.
    """
    rows = measure(docs)
    limits = land(
        fences(sketches(rows.selectExpr("_row.lang", "_row.source", *RATES))), "quality_fences"
    )
    judged = verdict(rows, limits, F.col("_row.lang"), F.col("_row.source"))
    return judged.select(F.inline(F.expr("CASE WHEN kept THEN array(_row) ELSE array() END")))
