"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item. Of the seven four-word grams in a
window the one with the least hash is its fingerprint. Equal windows have equal
fingerprints, so every shared span of ten words or more is found; and as neighbouring
windows mostly share theirs, few are looked up. Where a fingerprint of a document
is one of the benchmark, the hit is extended: its windows are compared as a whole and
all their words marked. Items of fewer than ten words are one window each, which is its own fingerprint,
and are looked up by their own length.

The benchmark's windows are counted first. Up to ``broadcast_windows`` they go to every
task as sorted arrays, and a document is settled where it is read. A larger benchmark
is joined by fingerprint instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.words import BY_LETTERS, gram_hash, gram_hash_at, hashed_words, pieces, text_buffers
from salescope.llm.workers import map_batches

WINDOW = 10
GRAM = 4
#: Benchmarks of more windows are joined by fingerprint. This many take about 16 MB as arrays,
#: and 300 MB of the driver's Python while these are made.
BROADCAST_WINDOWS = 250_000

ITEM_WINDOWS = "item_id string, length int, window long, fingerprint long"
DOC_WINDOWS = "doc_id long, text_hash long, n_words long, start int, length int, fingerprint long, windows array<long>"
FOUND = "doc_id long, n_words long, n_hit long, items array<string>"


def _least(grams: np.ndarray) -> np.ndarray:
    """Least gram of each window, by doubling the span of the minimum."""
    span, least, width = WINDOW - GRAM + 1, grams, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _whole(first: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which runs of ``size`` words, by their first word, lie within one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text[: max(0, count - size + 1)] == text[size - 1 :]


def _signed(value: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(value).view(np.int64)


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the benchmark with their fingerprints."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        words, first = hashed_words(data, offsets, BY_LETTERS)
        out: dict[str, list] = {"item_id": [], "length": [], "window": [], "fingerprint": []}
        for row, item in enumerate(batch.column("item_id").to_pylist()):
            own = words[first[row] : first[row + 1]]
            if len(own) == 0:
                continue
            size = min(len(own), WINDOW)
            windows = _signed(gram_hash(own, size))
            least = _signed(_least(gram_hash(own, GRAM))) if size == WINDOW else windows
            out["item_id"] += [item] * len(windows)
            out["length"] += [size] * len(windows)
            out["window"] += windows.tolist()
            out["fingerprint"] += least.tolist()
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


class Lookup:
    """Membership in a fixed set of fingerprints: a bit table first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.keys = np.unique(values.astype(np.uint64))
        bits = min(24, max(16, int(len(self.keys)).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys & self.mask] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that are members, and their places among the keys."""
        maybe = np.flatnonzero(self.table[values & self.mask])
        place = np.searchsorted(self.keys, values[maybe])
        place[place == len(self.keys)] = 0
        real = self.keys[place] == values[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        return maybe[real], place[real]


@dataclass
class Benchmark:
    """Windows by length, the items that hold each, and the fingerprints of full ones."""

    windows: dict[int, Lookup]
    items: dict[int, list[list[str | None]]]
    fingerprints: Lookup

    @classmethod
    def of(cls, rows: list) -> Benchmark:
        windows, items = {}, {}
        for length in sorted({r.length for r in rows}):
            own = [r for r in rows if r.length == length]
            look = Lookup(np.array([r.window for r in own], np.int64).view(np.uint64))
            place = np.searchsorted(look.keys, np.array([r.window for r in own], np.int64).view(np.uint64))
            holders: list[set] = [set() for _ in look.keys]
            for k, r in zip(place, own, strict=True):
                holders[k].add(r.item_id)
            windows[length], items[length] = look, [list(h) for h in holders]
        prints = [r.fingerprint for r in rows if r.length == WINDOW]
        return cls(windows, items, Lookup(np.array(prints, np.int64).view(np.uint64)))

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Hit words per text, and the items found in the texts that have any."""
        edges = np.zeros(len(words) + 1, np.int32)
        found: dict[int, set] = {}
        for length, look in self.windows.items():
            inside = _whole(first, len(words), length)
            if not len(inside):
                continue
            if length == WINDOW:
                least = _least(gram_hash(words, GRAM))
                changed = np.concatenate(([True], least[1:] != least[:-1]))
                hit, _ = self.fingerprints(least[changed])
                extend = np.zeros(int(changed.sum()), bool)
                extend[hit] = True
                at = np.flatnonzero(inside & extend[np.cumsum(changed) - 1])
            else:
                at = np.flatnonzero(inside)
            windows = gram_hash_at(words, at, length)
            hit, place = look(windows)
            np.add.at(edges, at[hit], 1)
            np.add.at(edges, at[hit] + length, -1)
            texts = np.searchsorted(first, at[hit], "right") - 1
            for text, k in set(zip(texts.tolist(), place.tolist(), strict=True)):
                found.setdefault(text, set()).update(self.items[length][k])
        covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
        return np.diff(covered[first]), found


def _scanned(batch: pa.RecordBatch, known: Benchmark) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict]]:
    """For each piece of a batch: its rows, their words, hit words and items."""
    data, offsets = text_buffers(batch.column("text"))
    for low, high in pieces(offsets):
        words, first = hashed_words(
            data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], BY_LETTERS
        )
        n_hit, found = known.find(words, first)
        yield low, high, np.diff(first), n_hit, found


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, n_words, n_hit, found in _scanned(batch, shared.value):
                items = [sorted(i for i in found[k] if i is not None) if k in found else [] for k in range(high - low)]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items"],
                )

    return find


def _dropper(shared):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [n_hit == 0 for _, _, _, n_hit, _ in _scanned(batch, shared.value)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.empty(0, bool)))

    return drop


def doc_windows(lengths: list[int]):
    """Windows of documents, one row per run of windows with the same fingerprint."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for low, high in pieces(offsets):
                words, first = hashed_words(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], BY_LETTERS
                )
                rows = [(ids[low + k], prints[low + k], int(n), 0, 0, 0, []) for k, n in enumerate(np.diff(first))]
                for length in lengths:
                    for k in range(high - low):
                        own = words[first[k] : first[k + 1]]
                        if len(own) < length:
                            continue
                        grams = gram_hash(own, length)
                        least = _least(gram_hash(own, GRAM)) if length == WINDOW else grams
                        edges = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
                        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                            key = int(least[a : a + 1].view(np.int64)[0])
                            run = _signed(grams[a:b]).tolist()
                            rows.append((ids[low + k], prints[low + k], len(own), a, length, key, run))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "text_hash", "n_words", "start", "length", "fingerprint", "windows"]
                yield pa.record_batch(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names
                )

    return windows


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same findings by joins alone, for a benchmark of any size."""
    lengths = [r.length for r in items.select("length").distinct().collect()]  # ten at most
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    runs = map_batches(keyed, doc_windows(sorted(lengths)), DOC_WINDOWS)
    full = items.where(f"length = {WINDOW}").select("length", "fingerprint").distinct()
    short = items.where(f"length < {WINDOW}").select("length", "fingerprint").distinct()
    likely = runs.where("length > 0").join(full.unionByName(short), ["length", "fingerprint"], "left_semi")
    hits = likely.selectExpr(
        "doc_id", "text_hash", "length", "start", "posexplode(windows) AS (offset, window)"
    ).join(items.select("length", "window", "item_id").distinct(), ["length", "window"])
    by = ["doc_id", "text_hash"]
    words = (
        hits.selectExpr(*by, "explode(sequence(start + offset, start + offset + length - 1)) AS word")
        .distinct()
        .groupBy(*by)
        .agg(F.count("*").alias("n_hit"))
    )
    named = hits.groupBy(*by).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    same = words["text_hash"].eqNullSafe(named["text_hash"]) & words["doc_id"].eqNullSafe(named["doc_id"])
    found = words.join(named, same)
    found = found.select(words["doc_id"].alias("_doc"), words["text_hash"].alias("_text"), "n_hit", "items")
    base = runs.where("length = 0").select("doc_id", "text_hash", "n_words")
    return base.join(found, F.expr("doc_id <=> _doc AND text_hash <=> _text"), "left").selectExpr(
        "doc_id", "text_hash", "n_words", "coalesce(n_hit, 0L) AS n_hit", "coalesce(items, array()) AS items"
    )


def _windows_of(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(items, item_windows, ITEM_WINDOWS)


def _small(items: DataFrame, limit: int) -> list | None:
    """The benchmark's windows if there are few enough, read at most one beyond."""
    if items.limit(limit + 1).count() > limit:
        return None
    return items.collect()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Words are lower-cased runs of letters, digits and characters beyond ASCII.
    ``n_hit`` counts words inside any occurrence of a window, ``items`` lists in text order
    the items with windows that occur. NULL text has no words, and an item without words
    has no window. An item without id hits but is not listed. Rows that repeat give
    repeated rows. Empty tables give no rows, or documents without hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _windows_of(benchmark)
    rows = _small(items, broadcast_windows)
    if rows is None:
        return _joined(docs, items).drop("text_hash")
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark.of(rows))
    return map_batches(docs, _finder(shared), FOUND)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    items = _windows_of(benchmark)
    rows = _small(items, broadcast_windows)
    if rows is not None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark.of(rows))
        return map_batches(docs, _dropper(shared), docs.schema)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dirty = _joined(slim, items).where("n_hit > 0").selectExpr("doc_id AS _doc", "text_hash AS _text").distinct()
    return docs.join(dirty, F.expr("doc_id <=> _doc AND xxhash64(text) = _text"), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
