"""Removal of long repeated byte strings with a logarithmic family of suffix indexes.

Every 100-byte window of a text is looked at through its anchor, the 20-byte gram in it
with the least fingerprint: equal windows have equal anchors in the same place, and
neighbouring windows mostly share theirs. A run of windows with one anchor is an entry, a
suffix of the text cut where the run ends. Entries are dealt to buckets by
their anchor's gram. A bucket takes them in batches: a batch is sorted, scanned
against every level of the index, and becomes a level; levels of like size merge, so
there are few and each entry is merged a logarithmic number of times. Of two equal entries
the later one is repeated as a whole.

Entries that share an anchor but differ somewhere still have equal windows
in part. Only their bytes are fetched, and their windows go through the same kind of
index one by one. Suffixes are sorted by fingerprint and not by their letters: whether
100 bytes are equal is all that is asked, and numbers of 64 bits sort much faster. Anchor
and content fingerprints have to agree, 128 bits in all.

A string that is very frequent costs a bucket one entry for each task that read it. An
anchor with very many different entries is split by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.words import mix, pieces, powers, span_hash, text_buffers
from salescope.llm.workers import map_batches
from salescope.sources.shared import land

# Fixed value: repeated strings of so many bytes go.
LENGTH = 100

GRAM = 20
#: Text bytes whose entries, and whose differing windows, are one bucket.
BUCKET_BYTES, WINDOW_BUCKET_BYTES = 60_000_000, 15_000_000
#: Entries of a batch, at least, unless it is a bucket's last.
BATCH = 1 << 16
#: An anchor with more different entries than this is split by window.
FREQUENT = 20_000

ENTRIES = "bucket int, kind int, payload binary"
SPANS = "doc_id long, text_hash long, kind int, data binary"
RESULT = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: Kinds of rows: settled spans; entries or their places; entries of frequent anchors.
SETTLED, ENTRY, WINDOW = 0, 1, 2

_VALUES = np.random.Generator(np.random.PCG64(31_607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
PLACE = np.dtype([("start", "<u4"), ("count", "u1")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
COLUMNS = ("print", "anchor", "doc", "text", "start", "count")


def byte_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return total


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of windows with one anchor: text, first window, windows, content, anchor."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    total = byte_hash(data)
    _, down = powers(len(data) + 1)
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    # Fingerprint above, place below: the least of a window is its leftmost least gram.
    least = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & _LOW).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = of[: len(anchor)] == of[LENGTH - 1 :]
    changed = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])))
    first = np.flatnonzero(changed)
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    real = inside[first]
    first, last = first[real], last[real]
    text, at = of[first].astype(np.int64), anchor[first]
    content = mix(span_hash(total, first, last + LENGTH) + (at - first).astype(np.uint64) * _GOLDEN)
    return text, first - offsets[text], last - first + 1, content, mix(gram[at] + _GOLDEN)


def _before(a: dict, b: dict) -> np.ndarray:
    """Where the entries ``a`` start earlier than the entries ``b``."""
    same = a["doc"] == b["doc"]
    text = (a["text"] < b["text"]) | (a["text"] == b["text"]) & (a["start"] < b["start"])
    return (a["doc"] < b["doc"]) | same & text


def _take(entries: dict, which: np.ndarray) -> dict:
    return {c: v[which] for c, v in entries.items()}


def _append(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in COLUMNS}


class Levels:
    """Sorted levels of entries, each the earliest with its content."""

    def __init__(self):
        self.levels: list[dict] = []

    def add(self, batch: dict) -> dict:
        """Takes a batch in; gives the entries, of it or of levels, that are not the earliest."""
        order = np.lexsort((batch["start"], batch["text"], batch["doc"], batch["anchor"], batch["print"]))
        batch = _take(batch, order)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (batch["print"][1:] != batch["print"][:-1]) | (batch["anchor"][1:] != batch["anchor"][:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        later = ~fresh & _before(_take(batch, head), batch)
        repeated, batch = [_take(batch, later)], _take(batch, fresh)
        for level in self.levels:
            place = np.searchsorted(level["print"], batch["print"])
            place[place == len(level["print"])] = 0
            met = np.flatnonzero(
                (level["print"][place] == batch["print"]) & (level["anchor"][place] == batch["anchor"])
            )
            mine, old = _take(batch, met), _take(level, place[met])
            repeated.append(_take(mine, _before(old, mine)))
            wins = _before(mine, old)
            repeated.append(_take(old, wins))
            for c in COLUMNS:
                level[c][place[met[wins]]] = mine[c][wins]
            rest = np.ones(len(batch["print"]), bool)
            rest[met] = False
            batch = _take(batch, rest)
        if len(batch["print"]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]["print"]) <= 2 * len(self.levels[-1]["print"]):
            both = _append([self.levels.pop(), self.levels.pop()])
            self.levels.append(_take(both, np.argsort(both["print"], kind="stable")))
        return _append(repeated)

    def entries(self) -> dict | None:
        return _append(self.levels) if self.levels else None


def _locally(entries: dict) -> tuple[dict, dict]:
    """Of a task's own entries: the earliest of each content, and those that are repeated."""
    index = Levels()
    repeated = index.add(entries)
    return index.entries() or entries, repeated


def _rows(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _span_rows(kind: int, entries: dict, data: np.ndarray) -> pa.RecordBatch:
    """One row per text with the packed ``data`` of its entries."""
    names, types = ["doc_id", "text_hash", "kind", "data"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    order = np.lexsort((entries["start"], entries["text"], entries["doc"]))
    doc, text, data = entries["doc"][order], entries["text"][order], data[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    edges = np.flatnonzero(np.append(new, True))
    packed = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _rows([doc[new], text[new], np.full(len(packed), kind), packed], names, types)


def _as_spans(entries: dict) -> np.ndarray:
    out = np.empty(len(entries["start"]), SPAN)
    out["start"] = entries["start"]
    out["end"] = entries["start"] + entries["count"] + LENGTH - 1
    return out


def _packed(entries: dict, bucket: np.ndarray, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A compressed payload for each bucket, with the texts' keys stored once."""
    order = np.lexsort((entries["start"], entries["text"], entries["doc"], bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        own = _take(entries, order[edges[k] : edges[k + 1]])
        new = np.ones(len(own["doc"]), bool)
        new[1:] = (own["doc"][1:] != own["doc"][:-1]) | (own["text"][1:] != own["text"][:-1])
        size = np.diff(np.flatnonzero(np.append(new, True)))
        parts = [
            np.array([len(size), len(new)], "<i8"),
            own["doc"][new].astype("<i8"),
            own["text"][new].astype("<i8"),
            size.astype("<u4"),
            own["start"].astype("<u4"),
            own["count"].astype("u1"),
            own["anchor"].astype("<u8"),
            own["print"].astype("<u8"),
        ]
        yield k, kind, b"".join(p.tobytes() for p in parts)


def _unpacked(payload: bytes) -> dict:
    texts, rows = np.frombuffer(payload, "<i8", 2).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    doc, text, size = take("<i8", texts), take("<i8", texts), take("<u4", texts)
    start, count = take("<u4", rows).astype(np.int64), take("u1", rows).astype(np.int64)
    anchor, content = take("<u8", rows), take("<u8", rows)
    return dict(
        zip(COLUMNS, (content, anchor, np.repeat(doc, size), np.repeat(text, size), start, count), strict=True)
    )


def _settled_payload(entries: dict, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Spans that a task could settle itself, sent along to any bucket."""
    if len(entries["doc"]):
        batch = _span_rows(SETTLED, entries, _as_spans(entries))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield int(entries["start"][0]) % buckets, SETTLED, sink.getvalue().to_pybytes()


def _emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return _rows([list(c) for c in columns], ["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()])


def _entries(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            doc, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            parts, held = [], 0
            for low, high in pieces(offsets):
                of, start, count, content, anchor = runs(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                )
                parts.append(
                    dict(zip(COLUMNS, (content, anchor, doc[low + of], text[low + of], start, count), strict=True))
                )
                held += len(of)
                if held > 2_000_000 or high == len(doc):
                    own, repeated = _locally(_append(parts))
                    bucket = (own["anchor"] % np.uint64(buckets)).astype(np.int64)
                    yield _emit([*_packed(own, bucket, buckets, ENTRY), *_settled_payload(repeated, buckets)])
                    parts, held = [], 0

    return emit


def _by_bucket(batches: Iterator[pa.RecordBatch]):
    def rows():
        for batch in batches:
            keys, kinds = batch.column("bucket").to_pylist(), batch.column("kind").to_pylist()
            yield from zip(keys, kinds, batch.column("payload"), strict=True)

    return groupby(rows(), key=lambda r: r[0])


def _indexed(payloads: Iterator[dict], index: Levels) -> Iterator[dict]:
    """Adds payloads in batches; gives repeated entries."""
    held, size = [], 0
    for entries in payloads:
        held.append(entries)
        size += len(entries["print"])
        if size >= BATCH:
            yield index.add(_append(held))
            held, size = [], 0
    if held:
        yield index.add(_append(held))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles whole entries; asks for the places of entries that only share an anchor."""
    for _, group in _by_bucket(batches):
        index, passed = Levels(), []

        def payloads(group=group, passed=passed):
            for _, kind, payload in group:
                if kind == SETTLED:
                    passed += pa.ipc.open_stream(payload.as_buffer()).read_all().to_batches()
                else:
                    yield _unpacked(payload.as_py())

        for repeated in _indexed(payloads(), index):
            if len(repeated["doc"]):
                yield _span_rows(SETTLED, repeated, _as_spans(repeated))
            yield from passed
            passed.clear()
        yield from passed
        entries = index.entries()
        if entries is None:
            continue
        _, inverse, sizes = np.unique(entries["anchor"], return_inverse=True, return_counts=True)
        for kind, which in ((ENTRY, (sizes > 1) & (sizes <= FREQUENT)), (WINDOW, sizes > FREQUENT)):
            asked = _take(entries, which[inverse])
            if len(asked["doc"]):
                places = np.empty(len(asked["doc"]), PLACE)
                places["start"], places["count"] = asked["start"], asked["count"]
                yield _span_rows(kind, asked, places)


def _windows(doc: int, text: int, starts: np.ndarray, counts: np.ndarray, content: np.ndarray) -> dict:
    """The single windows of some entries, whose bytes follow one another in ``content``."""
    total = byte_hash(content)
    size = counts + LENGTH - 1
    base = np.cumsum(size) - size
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(base, counts) + nth
    prints = span_hash(total, at, at + LENGTH)
    # A second fingerprint of the same bytes stands in for the anchor here.
    other = mix((total[at + LENGTH // 2] - total[at]) * powers(len(total))[1][at] + _GOLDEN)
    count = len(at)
    return dict(
        zip(
            COLUMNS,
            (prints, other, np.full(count, doc), np.full(count, text), np.repeat(starts, counts) + nth, np.ones(count, np.int64)),
            strict=True,
        )
    )


def _contents(buckets: int):
    """Bytes of the entries that were asked for, by anchor; frequent ones window by window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            doc, text = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            kept: list[list[bytes]] = [[] for _ in range(buckets)]
            single, held = [], 0
            for row, lists in enumerate(zip(batch.column("asked").to_pylist(), batch.column("frequent").to_pylist(), strict=True)):
                own = data[offsets[row] : offsets[row + 1]]
                for kind, asked in zip((ENTRY, WINDOW), lists, strict=True):
                    places = np.frombuffer(b"".join(asked), PLACE)
                    if len(places) == 0:
                        continue
                    start, count = places["start"].astype(np.int64), places["count"].astype(np.int64)
                    size = count + LENGTH - 1
                    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                    content = own[at]
                    if kind == WINDOW:
                        single.append(_windows(doc[row], text[row], start, count, content))
                        continue
                    # The anchor is found again from the bytes, as it belongs to each window.
                    bounds = np.concatenate(([0], np.cumsum(size)))
                    first = bounds[:-1]
                    anchor = _anchor_of(content, first)
                    for k in np.unique(anchor % np.uint64(buckets)).tolist():
                        which = np.flatnonzero(anchor % np.uint64(buckets) == k)
                        parts = [content[bounds[i] : bounds[i + 1]].tobytes() for i in which]
                        head = np.array([doc[row], text[row], len(which)], "<i8").tobytes()
                        kept[int(k)] += [head, places[which].tobytes(), *parts]
                    held += len(content)
                if held > 16_000_000:
                    yield _emit([(k, ENTRY, press.compress(b"".join(b))) for k, b in enumerate(kept) if b])
                    kept, held = [[] for _ in range(buckets)], 0
            rows = [(k, ENTRY, press.compress(b"".join(b))) for k, b in enumerate(kept) if b]
            if single:
                own, repeated = _locally(_append(single))
                rows += _packed(own, (own["print"] % np.uint64(buckets)).astype(np.int64), buckets, WINDOW)
                rows += _settled_payload(repeated, buckets)
            yield _emit(rows)

    return emit


def _anchor_of(content: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of the least gram of the windows that start at ``first``."""
    total = byte_hash(content)
    _, down = powers(len(content) + 1)
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(content) - GRAM + 1])
    at = first[:, None] + np.arange(LENGTH - GRAM + 1)
    least = np.argmin(gram[at] >> np.uint64(32), axis=1)
    return mix(gram[first + least] + _GOLDEN)


def scan_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles single windows."""
    for _, group in _by_bucket(batches):
        index, passed = Levels(), []

        def payloads(group=group, passed=passed):
            for _, kind, payload in group:
                if kind == SETTLED:
                    passed += pa.ipc.open_stream(payload.as_buffer()).read_all().to_batches()
                elif kind == WINDOW:
                    yield _unpacked(payload.as_py())
                else:
                    yield from _content_windows(zstandard.ZstdDecompressor().decompress(payload.as_py()))

        for repeated in _indexed(payloads(), index):
            if len(repeated["doc"]):
                yield _span_rows(SETTLED, repeated, _as_spans(repeated))
        yield from passed


def _content_windows(payload: bytes) -> Iterator[dict]:
    at = 0
    while at < len(payload):
        doc, text, count = np.frombuffer(payload, "<i8", 3, at).tolist()
        places = np.frombuffer(payload, PLACE, count, at + 24)
        start, counts = places["start"].astype(np.int64), places["count"].astype(np.int64)
        at += 24 + places.nbytes
        size = int((counts + LENGTH - 1).sum())
        yield _windows(doc, text, start, counts, np.frombuffer(payload, np.uint8, size, at))
        at += size


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated spans, as sizes and digest."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        out = []
        for row, lists in enumerate(batch.column("spans").to_pylist()):
            own = data[offsets[row] : offsets[row + 1]]
            kept, spans = kept_bytes(own, np.frombuffer(b"".join(lists or []), SPAN))
            out.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                *[pa.array(c, pa.int64()) for c in columns[:3]],
                pa.array(columns[3], pa.string()),
            ],
            names=["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def kept_bytes(text: np.ndarray, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs have gone."""
    if len(spans) == 0:
        return text.tobytes(), 0
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, spans["start"].astype(np.int64), 1)
    np.add.at(edges, spans["end"].astype(np.int64), -1)
    gone = np.cumsum(edges[:-1]) > 0
    return text[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Packed spans (``data``) of each text's bytes that start earlier elsewhere too."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(6, -(-total // BUCKET_BYTES))
    entries = map_batches(texts, _entries(buckets), ENTRIES)
    settled = land(map_batches(_grouped(entries, buckets), scan, SPANS), "suffix_entries")

    open_places = (
        settled.where(f"kind <> {SETTLED}")
        .groupBy("doc_id", "text_hash")
        .agg(
            *[
                F.expr(f"collect_list(data) FILTER (WHERE kind = {kind}) AS {name}")
                for kind, name in ((ENTRY, "asked"), (WINDOW, "frequent"))
            ]
        )
        .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
    )
    # One copy of a repeated row is enough here.
    asked = texts.join(open_places, F.expr("doc_id <=> _doc AND text_hash = _text")).drop("_doc", "_text")
    buckets = max(6, -(-total // WINDOW_BUCKET_BYTES))
    windows = map_batches(asked, _contents(buckets), ENTRIES)
    rest = land(map_batches(_grouped(windows, buckets), scan_windows, SPANS), "suffix_windows")
    return settled.where(f"kind = {SETTLED}").unionByName(rest).select("doc_id", "text_hash", "data")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256.

    ``docs`` has doc_id and text; other columns are ignored. A byte goes if a 100-byte
    string over it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings are judged on the input. NULL text is empty and keeps nothing.
    Rows that share a doc_id are ordered by a hash of their text; rows that repeat are one
    document, which is not its own earlier copy. NULL doc_id counts as the least. An
    empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    spans = (
        repeated_spans(texts)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("data").alias("spans"))
        .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
    )
    rows = texts.join(spans, F.expr("doc_id = _doc AND text_hash = _text"), "left").drop("_doc", "_text")
    return map_batches(rows, cut, RESULT).withColumn(
        "doc_id", F.expr(f"nullif(doc_id, {-(1 << 63) + 1}L - 1L)")
    )
