"""Removal of repeated runs of lines, by chunks of two neighbouring lines with words.

Chunks that a rolling hash bounds miss most short runs, as two boundaries have to fall inside. So every
line with words is a boundary here: a chunk goes from one to the next, chunks overlap by a line, and each
run of lines is a chain of them. A run occurs earlier only if all its chunks do: each
repeated run of two or more lines with words, however short and wherever it starts, is found
whole. Chunks depend on their own lines alone: a line put in or left out shifts no other.
Chunks whose fingerprint occurs more than once are fetched and grouped by their bytes, and
all but the first of equal ones are removed. The first occurrence of a line is in no later
copy of a chunk, so each line stays somewhere.

Only built-in functions are used. Chunks travel as fingerprints; texts are joined by
document, once for the chunks in doubt and once for what is left. A chunk that is very
frequent is counted before any shuffle, and meets its first occurrence in a join with one
row per chunk, which may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.sources.shared import land

_SAME = "doc_id <=> _doc AND text_hash = _text"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """Neighbouring lines with words, and what is between: doc_id, text_hash, s and e (first, last line), hash."""
    hashed = _texts(docs).selectExpr(
        "doc_id",
        "text_hash",
        r"transform(split(text, '\n'), x -> struct(xxhash64(x) AS h, x RLIKE r'[^\x20\x09-\x0D]' AS w)) AS _lines",
    )
    hashed = hashed.selectExpr("doc_id", "text_hash", "_lines.h AS _h", "_lines.w AS _w")
    worded = hashed.selectExpr("*", "filter(sequence(0, size(_h) - 1), i -> _w[i]) AS _at")
    return worded.selectExpr(
        "doc_id",
        "text_hash",
        "inline(transform(slice(_at, 2, size(_at)), (x, k) -> struct(_at[k] AS s, x AS e,"
        " xxhash64(slice(_h, _at[k] + 1, x - _at[k] + 1)) AS hash)))",
    )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Chunks that also occur earlier, byte for byte: doc_id, text_hash, s, e."""
    slim = land(chunks(docs), "line_chunks")
    often = slim.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    doubtful = (
        slim.join(often, "hash", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("s", "e", "hash")).alias("_asked"))
        .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
    )
    # The list grows with the corpus: no broadcast, however small it is.
    fetched = (
        _texts(docs)
        .join(doubtful.hint("merge"), F.expr(_SAME))
        .selectExpr("doc_id", "text_hash", r"split(text, '\n') AS _lines", "_asked")
        .selectExpr(
            "doc_id",
            "text_hash",
            r"inline(transform(_asked, c -> struct(c.s AS s, c.e AS e, c.hash AS hash, CASE WHEN size(_lines) > c.e"
            r" THEN array_join(slice(_lines, c.s + 1, c.e - c.s + 1), '\n') END AS chunk)))",
        )
    )
    fetched = land(fetched, "line_chunk_texts")
    place = F.struct("doc_id", "text_hash", "s")
    equal = fetched.groupBy("hash", "chunk").agg(F.min(place).alias("first"))
    # Different bytes with one key, should they ever occur, are all left alone.
    firsts = (
        equal.groupBy("hash", F.md5("chunk").alias("key"))
        .agg(F.count("*").alias("n"), F.min("first").alias("first"))
        .where("n = 1")
        .drop("n")
    )
    return (
        fetched.withColumn("key", F.md5("chunk"))
        .join(firsts, ["hash", "key"])
        .where(place > F.col("first"))
        .select("doc_id", "text_hash", "s", "e")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, text (what is left), n_lines, n_removed, n_chunks.

    ``docs`` has doc_id and text; other columns are ignored. Lines end at a line feed. A run
    that begins and ends with a line with words, and has two or more of them, is removed if
    it occurs earlier: at a smaller doc_id (NULL first), then a lesser text hash, then
    earlier in the text. ``n_chunks`` counts pairs of neighbouring lines of such runs. NULL
    text is one empty line. Rows that repeat are one document and give equal rows. An
    empty table gives no rows.
    """
    gone = (
        repeated_chunks(docs)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("s", "e")).alias("_gone"))
        .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
    )
    rows = _texts(docs).join(gone.hint("merge"), F.expr(_SAME), "left").selectExpr(
        "doc_id",
        "text_hash",
        r"split(text, '\n') AS _lines",
        "CASE WHEN _gone IS NULL THEN array() ELSE array_distinct(flatten(transform(_gone, g -> sequence(g.s, g.e)))) END AS _out",
        "coalesce(size(_gone), 0) AS n_chunks",
    )
    kept = rows.selectExpr("*", "array_except(sequence(0, size(_lines) - 1), _out) AS _kept")
    return kept.selectExpr(
        "doc_id",
        "text_hash",
        r"CASE WHEN size(_out) = 0 THEN array_join(_lines, '\n')"
        r" ELSE array_join(transform(_kept, i -> _lines[i]), '\n') END AS text",
        "CAST(size(_lines) AS BIGINT) AS n_lines",
        "CAST(size(_out) AS BIGINT) AS n_removed",
        "CAST(n_chunks AS BIGINT) AS n_chunks",
    )
