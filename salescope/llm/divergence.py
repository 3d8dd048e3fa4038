"""Audit of how sources of one language differ in their words.

Words are counted inside tasks, per language and source, before anything is shuffled. From then
on only counts matter: two terms with equal counts have equal probabilities and so equal
values. Terms are therefore grouped into cells of (count in the group, count in the language); the
value is evaluated once per cell, cells are ranked by the number of terms in those of higher value,
cells of equal value are merged, and only those that reach the wanted ranks are expanded to
terms, in UTF-8 order.

Pairs of sources are compared over all kept terms by cells too. Terms of one source alone come from
its own histogram of counts, those of neither are one cell, and only terms that both
have are joined, and counted per cell (count here, count there) at once.

All arithmetic is on whole numbers: 64 bits where the contract's bounds allow, else decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.words import pieces, text_buffers, word_spans
from salescope.llm.workers import map_batches
from salescope.sources.shared import land

#: A term is kept if it is in so many documents of its language.
LEAST_DOCS = 3
#: Probabilities are whole numbers of this scale.
SCALE = 1_000_000_000
#: Terms are ranked so far.
RANKS = 200
#: Bytes of texts that a task counts at a time.
TOGETHER = 8 << 20

# Bytes of terms, which are ASCII letters and everything beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, per language and source, of some texts at a time."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        for low, high in pieces(offsets, TOGETHER):
            own, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends, first = word_spans(own, edges, _LETTERS)
            if len(starts) == 0:
                continue
            # The words one after the other are all bytes that belong to words.
            upto = np.concatenate(([0], np.cumsum(ends - starts)))
            letters = pa.py_buffer(_LOWER[own[_LETTERS[own]]])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), letters).dictionary_encode()
            doc = np.repeat(np.arange(low, high), np.diff(first))
            key = group[doc] * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc = key[order], doc[order]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.flatnonzero(fresh)
            new_doc = fresh | np.concatenate(([True], doc[1:] != doc[:-1]))
            of, term = np.divmod(key[begin], len(words.dictionary))
            lang, source = np.divmod(of, len(sources.dictionary))
            yield pa.record_batch(
                [
                    langs.dictionary.take(pa.array(lang)),
                    sources.dictionary.take(pa.array(source)),
                    words.dictionary.take(pa.array(term)).cast(pa.string()),
                    pa.array(np.diff(np.append(begin, len(key)))),
                    pa.array(np.add.reduceat(new_doc.astype(np.int64), begin)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def kept_terms(docs: DataFrame) -> DataFrame:
    """Per kept term and source: lang, source, term, n, its count ``whole`` in the language, and ``head``,
    1 in one of the term's rows."""
    counted = map_batches(docs, count_terms, COUNTED)
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = "OVER (PARTITION BY lang, term)"  # one row per source
    return sums.selectExpr(
        "lang",
        "source",
        "term",
        "n",
        f"sum(n) {over} AS whole",
        f"sum(docs) {over} AS _docs",
        "CASE WHEN row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 THEN 1L ELSE 0L END AS head",
    ).where(f"_docs >= {LEAST_DOCS}").drop("_docs")


def _chance(count: str, total: str) -> str:
    """Smoothed probability of a term; ``total`` is of all terms, one added for each."""
    return f"(1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0)))"


def _gap(p: str, q: str) -> str:
    """Squared difference over q, at most the scale squared, which 64 bits hold."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _wide(value: str) -> str:
    return f"CAST({value} AS DECIMAL(19,0))"


def _pair_sums(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The value of each ordered pair of a language's sources, over all kept terms."""
    pairs = groups.selectExpr("lang", "source", "total", "own_terms", "terms").join(
        groups.selectExpr("lang AS _lang", "source AS item", "total AS item_total", "own_terms AS item_terms"),
        F.expr("lang = _lang AND source <> item"),
    ).drop("_lang")
    p0, q0 = _chance("0", "total"), _chance("0", "item_total")
    p, q = _chance("n", "total"), _chance("m", "item_total")
    none = pairs.where("terms > 0").selectExpr(
        "lang", "source", "item", f"{_wide(_gap(p0, q0))} * {_wide('terms - own_terms - item_terms')} AS value"
    )
    sizes = cells.groupBy("lang", "source", "n").agg(F.sum("cell").alias("cell"))
    here = pairs.join(sizes, ["lang", "source"]).selectExpr(
        "lang", "source", "item", f"{_wide(_gap(p, q0))} * {_wide('cell')} AS value"
    )
    there = pairs.join(sizes.selectExpr("lang", "source AS item", "n AS m", "cell"), ["lang", "item"]).selectExpr(
        "lang", "source", "item", f"{_wide(_gap(p0, q))} * {_wide('cell')} AS value"
    )
    rows = kept.select("lang", "term", "source", "n")
    both = (
        rows.join(rows.selectExpr("lang", "term", "source AS item", "n AS m"), ["lang", "term"])
        .where("source < item")
        .groupBy("lang", "source", "item", "n", "m")
        .agg(F.count("*").alias("cell"))
    )
    # What the terms of both have counted twice above is taken back, for either direction.
    ways = both.unionByName(both.selectExpr("lang", "item AS source", "source AS item", "m AS n", "n AS m", "cell"))
    change = " - ".join([f"{_wide(_gap(p, q))}", f"{_wide(_gap(p, q0))}", f"{_wide(_gap(p0, q))}"])
    shared = pairs.join(ways, ["lang", "source", "item"]).selectExpr(
        "lang", "source", "item", f"CAST({change} + {_wide(_gap(p0, q0))} AS DECIMAL(19,0)) * {_wide('cell')} AS value"
    )
    parts = none.unionByName(here).unionByName(there).unionByName(shared)
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return pairs.select("lang", "source", "item").join(sums, ["lang", "source", "item"], "left").selectExpr(
        "lang", "source", "'pair' AS part", "item", "CAST(coalesce(value, 0) AS BIGINT) AS value"
    )


def _top_terms(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms that are more probable in a group than in its language, with their ranks."""
    p, q = _chance("n", "total"), _chance("whole", "lang_total")
    valued = (
        cells.join(groups, ["lang", "source"])
        .selectExpr("lang", "source", "n", "whole", "cell", f"{p} AS p", f"{q} AS q")
        .where("p > q")
        .selectExpr("lang", "source", "n", "whole", "cell", f"{_gap('p', 'q')} AS value")
    )
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("cell").alias("cell")).selectExpr(
        "lang", "source", "value", "sum(cell) OVER (PARTITION BY lang, source ORDER BY value DESC) - cell AS before"
    ).where(f"before < {RANKS}")
    reached = valued.drop("cell").join(merged, ["lang", "source", "value"])
    # The filter on the place lets Spark limit a value's terms before they are shuffled.
    return (
        kept.join(reached, ["lang", "source", "n", "whole"])
        .selectExpr(
            "lang", "source", "value", "before", "term AS item",
            "row_number() OVER (PARTITION BY lang, source, value ORDER BY term) AS place",
        )
        .where(f"place <= {RANKS}")
        .selectExpr("lang", "source", "'term' AS part", "item", "value", "CAST(before + place AS INT) AS rank")
        .where(f"rank <= {RANKS}")
    )


def audit_sources(docs: DataFrame) -> DataFrame:
    """Rows of lang, source, part, item, value, rank: how a source differs from others and in which terms.

    ``docs`` has text, lang and source; NULL counts as an empty text in each, other columns are ignored.
    A term is a run of ASCII letters and characters beyond ASCII, with A-Z in lower case; a language keeps the
    terms of at least three of its documents. Part ``pair`` has every other source of the language
    as item, also where no term is kept (value 0), and every rank. Part ``term`` has the terms that are more
    probable in the group than in the language, to rank 200. Equal values are ranked by the item's UTF-8
    bytes. Repeated rows are documents of their own. An empty table gives no rows.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = land(kept_terms(texts), "divergence_terms")
    cells = land(kept.groupBy("lang", "source", "n", "whole").agg(F.count("*").alias("cell"), F.sum("head").alias("heads")), "divergence_cells")
    own = cells.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("cell")).alias("n"), F.sum("cell").alias("own_terms"), F.sum("heads").alias("heads")
    )
    over = "OVER (PARTITION BY lang)"  # one row per source
    groups = land(
        texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["n", "own_terms", "heads"])
        .selectExpr("lang", "source", "n", "own_terms", f"sum(heads) {over} AS terms", f"sum(n) {over} AS lang_n")
        .selectExpr("lang", "source", "own_terms", "terms", "n + terms AS total", "lang_n + terms AS lang_total"),
        "divergence_groups",
    )
    pairs = _pair_sums(kept, cells, groups).selectExpr(
        "*", "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank"
    )
    return pairs.unionByName(_top_terms(kept, cells, groups))
