"""Token ids as binary shards with a minimal perfect hash index in each.

Documents are put in order of doc_id and encoded. A shard holds the raw ids of some
documents and an index from document keys to the places of their ids. Spark's own
writer commits the shards, one file each, so a lost or repeated task leaves no trace and any
storage that Spark writes to will do.

Encoding takes texts apart before single spaces between words, where no token of a
byte-level vocabulary crosses, encodes every distinct part once per worker, and puts the
ids together with numpy. Tokenizers of another kind encode whole texts.

Shard format, little-endian: the header (see ``HEADER``), ids, document keys, occurrence
of a key, starts of documents, bucket seeds, then fingerprint and document of each slot.
A key's bucket tells a seed, key and seed tell its slot, and the slot's fingerprint
tells with certainty of 1 - 2**-32 whether a key is there at all.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.words import mix, pieces, powers, span_hash, text_buffers
from salescope.llm.workers import map_batches
from salescope.sources.shared import fresh_path, land

MAGIC = b"TOKSHRD1"
#: Magic, partition, shard in it, bytes of an id, documents, ids, buckets.
HEADER = np.dtype(
    [("magic", "S8"), ("partition", "<u4"), ("shard", "<u4"), ("width", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("buckets", "<u4")]
)
#: A shard is closed by the document that reaches so many ids, or is the last of so many.
SHARD_IDS, SHARD_DOCS = 4_000_000, 1 << 16
END_ID = 0
#: The key of rows without a doc_id, the least of 64 bits, so that they come first.
NO_KEY = -(1 << 63)
#: Documents in a bucket of the index, on average.
BUCKET_KEYS = 4
#: Bytes of text parts and their ids that a worker remembers, and parts that it encodes in one go.
REMEMBERED_BYTES, TOGETHER = 16 << 20, 1 << 12

_CASED = np.random.Generator(np.random.PCG64(77_003)).integers(1, 1 << 63, 256, dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[int, Encoder] = {}


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed tokenizer files have this one."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by the tokenizers library."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # Read and left before the tokenizer is made, as it takes several times the file's size.
        model = json.loads(config)
        split = model.get("pre_tokenizer") or {}
        self.by_parts = (
            model["model"]["type"] == "BPE"
            and not model.get("normalizer")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in model["added_tokens"])
        )
        del model
        self.tokenizer = Tokenizer.from_str(config)
        vocabulary = self.tokenizer.get_vocab()
        self.starts_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts_word[[number for token, number in vocabulary.items() if token.startswith("Ġ")]] = True
        self.width = 2 if len(self.starts_word) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.forget()

    def forget(self) -> None:
        """Leaves the tables of parts: fingerprints in order, where each one's ids begin, how many it has."""
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, self.kind)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some parts, one after the other in an order of its own: the order, the sizes, the ids.

        Those of one leading space go together as one text.
        """
        size = ends - starts
        spaces = np.concatenate(([0], np.cumsum(data == 0x20, dtype=np.int32)))
        plain = (data[starts] == 0x20) & (spaces[ends] - spaces[starts] == 1)
        order, sizes, ids = [], [], []
        # The library keeps far more than ids per token, so few parts go in at a time.
        every = np.flatnonzero(plain)
        for low in range(0, len(every), TOGETHER):
            order.append(every[low : low + TOGETHER])
            length = size[order[-1]]
            at = np.repeat(starts[order[-1]] - np.cumsum(length) + length, length) + np.arange(length.sum())
            ids.append(self._whole([data[at].tobytes().decode()])[0])
            sizes.append(np.diff(np.append(np.flatnonzero(self.starts_word[ids[-1]]), len(ids[-1]))))
        every = np.flatnonzero(~plain)
        for low in range(0, len(every), TOGETHER):
            order.append(every[low : low + TOGETHER])
            found = self._whole([data[starts[k] : ends[k]].tobytes().decode() for k in order[-1].tolist()])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids += found
        return np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)

    def _remember(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.keys.nbytes + self.begin.nbytes + self.size.nbytes + self.ids.nbytes > REMEMBERED_BYTES:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if not new.any():
            return
        order, size, ids = self._parts(data, starts[new], ends[new])
        begin = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        back = np.argsort(order)
        place = place[new]
        self.keys = np.insert(self.keys, place, keys[new])
        self.begin = np.insert(self.begin, place, begin[back])
        self.size = np.insert(self.size, place, size[back].astype(np.int32))
        self.ids = np.concatenate((self.ids, ids))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of some texts start, and their fingerprints."""
        if len(data) == 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
        wide = data >= 0x80
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 0x20) & ~space[:-2] & ~space[2:] & ~(wide[:-2] & wide[2:])
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        up, _ = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CASED[data] * up[: len(data)], out=total[1:])
        return starts, span_hash(total, starts, np.concatenate((starts[1:], [len(data)])))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        if not self.by_parts:
            whole = self._whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.concatenate([np.empty(0, self.kind), *whole]), np.array([len(x) for x in whole], np.int64)
        if len(data) == 0:
            return np.empty(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        starts, prints = self._cut(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, at, place = np.unique(prints, return_index=True, return_inverse=True)
        self._remember(data, keys, starts[at], ends[at])
        known = np.searchsorted(self.keys, keys)[place]
        size = self.size[known]
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.ids[np.repeat(self.begin[known] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])


def _encoder(shared) -> Encoder:
    key = zlib.crc32(shared.value.encode())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(shared.value)
    return _loaded[key]


def _hash_keys(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(keys.view(np.uint64)) + occurrence.astype(np.uint64) * _GOLDEN)


def _slots(hashed: np.ndarray, seed: np.ndarray, count: int) -> np.ndarray:
    return (mix(hashed + (seed.astype(np.uint64) + np.uint64(1)) * _GOLDEN) % np.uint64(count)).astype(np.int64)


def build_index(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, fingerprints and documents of a minimal perfect hash of distinct hashes.

    Buckets are placed from the largest down, each with the first seed that sends its
    keys to free slots.
    """
    count = len(hashed)
    buckets = max(1, -(-count // BUCKET_KEYS))
    seeds = np.zeros(buckets, np.uint32)
    document = np.full(count, -1, np.int64)
    of = (hashed >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    tries = np.arange(256, dtype=np.uint64)
    for bucket in np.argsort(-np.diff(edges), kind="stable").tolist():
        own = order[edges[bucket] : edges[bucket + 1]]
        if len(own) == 0:
            break
        base = 0
        while True:
            slots = _slots(hashed[own][None, :], (tries + np.uint64(base))[:, None], count)
            ranked = np.sort(slots, axis=1)
            good = (document[slots] < 0).all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                break
            base += len(tries)
        pick = int(np.argmax(good))
        seeds[bucket] = base + pick
        document[slots[pick]] = own
    return seeds, (hashed[document] & np.uint64(0xFFFFFFFF)).astype("<u4"), document.astype("<u4")


def pack(partition: int, shard: int, keys: np.ndarray, ids: list[np.ndarray], kind: np.dtype) -> bytes:
    """One shard: ``keys`` ascending, with the ids of each document in the same order."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    occurrence = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    seeds, prints, document = build_index(_hash_keys(keys, occurrence))
    head = np.array([(MAGIC, partition, shard, kind.itemsize, len(keys), size.sum(), len(seeds))], HEADER)
    starts = np.concatenate(([0], np.cumsum(size)))
    parts = [
        head,
        np.concatenate([np.empty(0, kind), *ids]),
        keys.astype("<i8"),
        occurrence.astype("<u4"),
        starts.astype("<u8"),
        seeds.astype("<u4"),
        prints,
        document,
    ]
    return b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's content, with keyed access in constant time."""

    def __init__(self, content: bytes):
        head = np.frombuffer(content, HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token shard")
        self.partition, self.shard = int(head["partition"]), int(head["shard"])
        docs, at = int(head["docs"]), HEADER.itemsize

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, count, at)
            at += found.nbytes
            return found

        self.ids = take(f"<u{head['width']}", int(head["ids"]))
        self.keys, self.occurrence = take("<i8", docs), take("<u4", docs)
        self.starts, self.seeds = take("<u8", docs + 1), take("<u4", int(head["buckets"]))
        self.prints, self.document = take("<u4", docs), take("<u4", docs)

    def places(self, keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Documents of some keys, -1 where the fingerprint says that one is not here."""
        hashed = _hash_keys(keys.astype(np.int64), occurrence)
        seed = self.seeds[((hashed >> np.uint64(32)) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = _slots(hashed, seed, len(self.keys))
        same = self.prints[slot] == (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(same, self.document[slot].astype(np.int64), -1)

    def get(self, key: int, occurrence: int = 0) -> np.ndarray | None:
        """Ids of a document, None if it is not in this shard."""
        place = int(self.places(np.array([key]), np.array([occurrence]))[0])
        if place < 0 or self.keys[place] != key or self.occurrence[place] != occurrence:
            return None
        return self.ids[int(self.starts[place]) : int(self.starts[place + 1])]


def _shards(shared, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition, shard = _encoder(shared), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0
        end = np.array([end_id], encoder.kind)

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            content = pack(partition, shard, np.array(keys, np.int64), ids, encoder.kind)
            shard, held = shard + 1, 0
            keys.clear()
            ids.clear()
            return pa.record_batch([pa.array([content], pa.binary())], names=["content"])

        try:
            for batch in batches:
                data, offsets = text_buffers(batch.column("text"))
                numbers = batch.column("doc_id").to_pylist()
                for low, high in pieces(offsets):
                    found, size = encoder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    upto = np.concatenate(([0], np.cumsum(size)))
                    for k in range(high - low):
                        keys.append(numbers[low + k])
                        ids.append(np.concatenate((found[upto[k] : upto[k + 1]], end)))
                        held += len(ids[-1])
                        if held >= shard_ids or len(keys) >= SHARD_DOCS:
                            yield close()
            if keys:
                yield close()
        finally:  # the worker lives on and reads other stages' rows
            encoder.forget()

    return write


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> None:
    """Encodes ``docs`` (doc_id, text) in ascending order of doc_id to shards at ``path``.

    NULL text is empty and has the end id alone. Rows that share a doc_id are ordered by
    a hash of their text and numbered in the index. A document longer than a shard
    is a shard of its own; ids never leave out a part of a text. Rows with a NULL doc_id come
    first, under the key ``NO_KEY``, which no document may have as its id; they are read as NULL
    again. An empty table writes no shard. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    # The text writer puts out a value's bytes as they are, and a line end after each file.
    map_batches(ordered, _shards(shared, end_id, shard_ids), "content binary").select(
        F.col("content").cast("string").alias("value")
    ).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            if len(content.as_buffer()) < HEADER.itemsize:
                continue  # the file of a task without rows
            shard = Shard(content.as_buffer())
            place = shard.places(shard.keys, shard.occurrence)
            if not np.array_equal(place, np.arange(len(place))):
                raise ValueError("the index does not lead to its documents")
            bounds = shard.starts.astype(np.int64)
            ids = shard.ids.astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            count = len(place)
            yield pa.record_batch(
                [
                    pa.array(np.full(count, shard.partition, np.int64)),
                    pa.array(np.full(count, shard.shard, np.int64)),
                    pa.array(shard.keys, mask=shard.keys == NO_KEY),
                    pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(np.array(sums, np.int64)),
                ],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32.

    Every key is looked up through its shard's index. ``start`` adds the ids of all
    earlier shards: totals per partition are summed first, then those of its shards.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long"
    rows = land(map_batches(files, _read, schema), "token_rows")
    shards = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("m")).selectExpr("part", "sum(m) OVER (ORDER BY part) - m AS before")
    starts = shards.join(parts, "part").selectExpr(
        "part", "shard", "before + sum(n) OVER (PARTITION BY part ORDER BY shard) - n AS first"
    )
    return rows.join(land(starts, "token_starts"), ["part", "shard"]).selectExpr(
        "doc_id", "first + at AS start", "n_tokens", "ids_crc32"
    )


def token_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes shards to the shared folder and gives what :func:`read_shards` finds there."""
    path = fresh_path(docs.sparkSession, "token_shards")
    write_shards(docs, path, tokenizer_path)
    return read_shards(docs.sparkSession, path)
