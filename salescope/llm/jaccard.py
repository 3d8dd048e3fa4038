"""N-gram Jaccard join with a prefix tree.

A document is the set of its five-word shingles, as fingerprints in one global order:
rare ones first, by counts that are taken over all documents, common ones last. Two sets
with a Jaccard similarity of 0.75 share one of the first quarter of their shingles, so
only these are shuffled, as 16 bytes each, whatever the number of buckets. Documents that
share some are a group, and equal groups one. There an exact upper bound from parity
bitmaps drops nearly all pairs that only share a passage; the rest ties documents to
clusters. A bitmap travels once for each group of its document, and most shingles
have none. Each cluster's sets then go to one task, or to one
for each pair of its blocks. There they are stored in a prefix tree with the common
end first, so near copies share long paths. Every set walks down the
tree, the overlap so far is found once for a shared path, and a subtree is left as soon
as what remains of the set or of the subtree cannot reach the overlap that is needed.

Documents with equal sets are one node from the first shuffle on, however many they are.
No pair ever becomes a row: tasks give sums of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.components import components
from salescope.llm.words import BY_SPACE, gram_hash, hashed_words, mix, pieces, text_buffers
from salescope.llm.workers import map_batches
from salescope.sources.shared import fresh_path, land, landing

# Shingle size and similarity. The tests below are 100 * common >= 75 * union.
SHINGLE = 5
SHARE, OF = 3, 4

#: A task names the shingles that so many of its documents have.
COMMON_IN_TASK = 8
#: So many of the most common shingles are ordered by count, in 2 MB. All others come first.
ORDERED = 1 << 17
#: First shingles that one task is to compare.
BUCKET_SHINGLES = 2_000_000
#: Partitions for each bucket, so that few buckets meet in one task.
SPREAD = 4
#: A common shingle's documents are split in blocks of about so many, and these paired.
SPLIT = 4096
#: Bytes of bitmaps, and members of groups, that a task compares at a time.
TIE_BYTES, TIE_MEMBERS = 1 << 26, 200_000
#: Sets and shingles in one block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Cells of the table that tells which set has which shingle, at a time.
CELLS = 1 << 25

PROFILE = "kind int, doc_id long, text_hash long, n long, sig binary, bits binary, n_docs long"
POSTINGS = "bucket int, payload binary"
GROUPS = "grp binary, ref binary"
EDGES = "a binary, b binary"
LINKS = "sig binary, links long, root binary"


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's position and sorted distinct shingles."""
    data, offsets = text_buffers(batch.column("text"))
    for low, high in pieces(offsets):
        words, first = hashed_words(
            data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], BY_SPACE
        )
        grams = gram_hash(words, SHINGLE)
        for k in range(high - low):
            count = first[k + 1] - first[k]
            if count >= SHINGLE:
                own = np.sort(grams[first[k] : first[k + 1] - SHINGLE + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif count:
                own = gram_hash(words[first[k] : first[k + 1]], int(count))
            else:
                own = np.empty(0, np.uint64)
            yield low + k, own


def signature(own: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    one, two = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(own + np.uint64(0x14057B7EF767814F)).sum()
    return mix(np.array([one + np.uint64(len(own)), two], np.uint64)).tobytes()


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature and (of copies in a batch one) bitmap of each document, and the shingles common in this task."""
    held: list[np.ndarray] = []
    seen: set[bytes] = set()

    def common() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
        often = counts >= COMMON_IN_TASK
        held.clear()
        seen.clear()
        return _profile_rows(1, values[often].view(np.int64), None, None, None, None, counts[often])

    for batch in batches:
        sizes, signs, bits = [], [], []
        mapped: set[bytes] = set()
        for _, own in shingle_sets(batch):
            sizes.append(len(own))
            signs.append(signature(own) if len(own) else None)
            bits.append(parity_bits(own).tobytes() if len(own) and signs[-1] not in mapped else None)
            mapped.add(signs[-1])
            if len(own) and signs[-1] not in seen:
                seen.add(signs[-1])
                held.append(own)
        yield _profile_rows(0, batch.column("doc_id"), batch.column("text_hash"), sizes, signs, bits, None)
        if sum(map(len, held)) > 2_000_000:
            yield common()
    if held:
        yield common()


def _profile_rows(kind: int, doc_id, text_hash, sizes, signs, bits, counts) -> pa.RecordBatch:
    rows = len(doc_id)
    none = lambda t: pa.nulls(rows, t)
    return pa.record_batch(
        [
            pa.array(np.full(rows, kind, np.int32)),
            pa.array(doc_id, pa.int64()) if isinstance(doc_id, np.ndarray) else doc_id,
            none(pa.int64()) if text_hash is None else text_hash,
            none(pa.int64()) if sizes is None else pa.array(sizes, pa.int64()),
            none(pa.binary()) if signs is None else pa.array(signs, pa.binary()),
            none(pa.binary()) if bits is None else pa.array(bits, pa.binary()),
            none(pa.int64()) if counts is None else pa.array(counts, pa.int64()),
        ],
        names=["kind", "doc_id", "text_hash", "n", "sig", "bits", "n_docs"],
    )


def first_shingles(own: np.ndarray, ordered: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a set, in the global order, that a similar one must share, with counts.

    The order is by count, 0 for all that are not common, then by fingerprint.
    """
    keep = len(own) - -(-SHARE * len(own) // OF) + 1
    place = np.searchsorted(ordered, own)
    place[place == len(ordered)] = 0
    often = np.where(ordered[place] == own, counts[place], 0) if len(ordered) else np.zeros(len(own), np.int64)
    order = np.argsort(often, kind="stable")[:keep]
    return own[order], often[order]


def parity_bits(own: np.ndarray) -> np.ndarray:
    """Bit i tells if an odd number of shingles falls on i; about as many bits as shingles."""
    size = 1 << max(6, int(len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool))


def _fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the size: parities of positions that then coincide."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def _postings(shared, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, counts = shared.value
        for batch in batches:
            seen: set[bytes] = set()
            keys, refs = [], []
            held = 0
            for _, own in shingle_sets(batch):
                sign = signature(own) if len(own) else b""
                if not len(own) or sign in seen:
                    continue
                seen.add(sign)
                tokens, often = first_shingles(own, ordered, counts)
                parts = np.maximum(1, -(-often // SPLIT))
                if (parts > 1).any():
                    tokens = _split(tokens, parts, int.from_bytes(sign[:8], "little"))
                keys.append(tokens)
                refs.append(np.full(len(tokens), np.frombuffer(sign, np.uint64, 1)[0]))
                held += len(tokens)
                if held > 2_000_000:
                    yield _packed(np.concatenate(keys), np.concatenate(refs), buckets)
                    keys, refs, held = [], [], 0
            if keys:
                yield _packed(np.concatenate(keys), np.concatenate(refs), buckets)

    return emit


def _split(tokens: np.ndarray, parts: np.ndarray, sign: int) -> np.ndarray:
    """Keys of shingles whose documents are split: one for each pair of blocks with its own."""
    out = [tokens[parts == 1]]
    for token, count in zip(tokens[parts > 1], parts[parts > 1].tolist(), strict=True):
        own = sign % count
        other = np.arange(count, dtype=np.uint64)
        low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
        out.append(mix(token + mix(low * np.uint64(count) + high + np.uint64(1))))
    return np.concatenate(out)


def _packed(keys: np.ndarray, refs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """For each bucket its keys, then the documents that have them."""
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    numbers, payloads = [], []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[k] : edges[k + 1]]
        payloads.append(keys[own].tobytes() + refs[own].tobytes())
        numbers.append(k)
    return pa.record_batch([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that share a key, once for equal groups of a bucket; rows come sorted by bucket.

    A document is named by the first 8 bytes of its signature. Should two have the same, both are in the group.
    """

    def rows():
        for batch in batches:
            yield from zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[0]):
        halves = [np.frombuffer(payload.as_py(), np.uint64).reshape(2, -1) for _, payload in group]
        keys, refs = np.concatenate(halves, axis=1)
        order = np.lexsort((refs, keys))
        keys, refs = keys[order], refs[order]
        # Copies of one set from several tasks become one; then keys of a single document go.
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])))
        keys, refs = keys[fresh], refs[fresh]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        several = np.flatnonzero(np.diff(starts) > 1)
        done: set[bytes] = set()
        named, members, held = [], [], 0
        for a, b in zip(starts[several].tolist(), starts[several + 1].tolist(), strict=True):
            name = signature(refs[a:b])
            if name in done:
                continue
            done.add(name)
            named += [name] * (b - a)
            members.append(refs[a:b])
            held += b - a
            if held > 500_000:
                yield _group_rows(named, members)
                named, members, held = [], [], 0
        if named:
            yield _group_rows(named, members)


def _group_rows(named: list[bytes], members: list[np.ndarray]) -> pa.RecordBatch:
    refs = pa.Array.from_buffers(pa.binary(8), len(named), [None, pa.py_buffer(np.concatenate(members).tobytes())])
    return pa.record_batch([pa.array(named, pa.binary()), refs.cast(pa.binary())], names=["grp", "ref"])


class _Block:
    """Groups that are compared together, and the sets in them."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.sizes, self.bits, self.groups = [], [], []
        self.members = self.bytes = 0

    def add(self, group: list[tuple[bytes, int, bytes]]) -> None:
        own = []
        for sign, size, bits in group:
            if sign not in self.number:
                self.number[sign] = len(self.number)
                self.sizes.append(size)
                self.bits.append(np.frombuffer(bits, np.uint8))
                self.bytes += len(bits)
            own.append(self.number[sign])
        self.members += len(own)
        self.groups.append(np.array(own))

    def full(self) -> bool:
        return self.bytes > TIE_BYTES or self.members > TIE_MEMBERS

    def edges(self) -> pa.RecordBatch:
        """A forest that ties all pairs which the bounds leave possible."""
        signs, sizes = list(self.number), np.array(self.sizes, np.int64)
        forest = _Forest(len(signs))
        for members in self.groups:
            self._tie(members, sizes, forest)
        tied = [k for k in range(len(signs)) if forest.parent[k] != k]
        tied += sorted({forest.root(k) for k in tied})
        a = [signs[k] for k in tied]
        b = _least_signs(a, [forest.root(k) for k in tied])
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def _tie(self, members: np.ndarray, sizes: np.ndarray, forest: _Forest) -> None:
        widths = np.array([len(self.bits[m]) for m in members])
        for width in np.unique(widths):
            own = members[widths == width]
            maps = np.stack([self.bits[m] for m in own])
            self._pairs(own, maps, own, maps, sizes, forest, True)
            # Sets within the length bound differ by one doubling at most.
            smaller = members[widths == width // 2]
            if len(smaller):
                self._pairs(smaller, np.stack([self.bits[m] for m in smaller]), own, _fold(maps), sizes, forest, False)

    @staticmethod
    def _pairs(left, left_maps, right, right_maps, sizes, forest: _Forest, within: bool) -> None:
        """Ties pairs that neither lengths nor bitmaps exclude, unless they are tied already."""
        for k, one in enumerate(left.tolist()):
            start = k + 1 if within else 0
            others = right[start:]
            n, m = sizes[one], sizes[others]
            likely = np.flatnonzero(OF * np.minimum(n, m) >= SHARE * np.maximum(n, m))
            root = forest.root(one)
            likely = likely[np.array([forest.root(x) != root for x in others[likely].tolist()], bool)]
            if len(likely) == 0:
                continue
            differ = np.bitwise_count(right_maps[start:][likely] ^ left_maps[k]).sum(axis=1, dtype=np.int64)
            # What differs is in one set only: overlap <= (n + m - differ) / 2.
            possible = n + m[likely] >= (SHARE + OF) * differ
            for other in others[likely[possible]].tolist():
                forest.tie(one, other)


def _least_signs(signs: list[bytes], labels: list[int]) -> list[bytes]:
    """The least signature under each one's label: the root of a tree of one level."""
    least: dict[int, bytes] = {}
    for sign, label in zip(signs, labels, strict=True):
        least[label] = min(sign, least.get(label, sign))
    return [least[label] for label in labels]


class _Forest:
    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def tie(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between documents that may be similar; rows come sorted by group."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("grp", "sig", "n", "bits")), strict=True)

    block = _Block()
    for _, group in groupby(rows(), key=lambda r: r[0]):
        block.add([row[1:] for row in group])
        if block.full():
            yield block.edges()
            block = _Block()
    if block.groups:
        yield block.edges()


def tree_links(stored: list[np.ndarray], probes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs as positions in ``stored`` and in ``probes``, or within ``stored``.

    Sets are arrays of distinct fingerprints, and no two of ``stored`` are equal.
    """
    within = probes is None
    sets = stored if within else stored + probes
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Common ones first; what only one set has can match nothing and is left out of the tree.
    order = np.lexsort((tokens, -counts))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    useful = int((counts > 1).sum())
    edges = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    ranks = [np.sort(rank[inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    ranks = [r[: np.searchsorted(r, useful)] for r in ranks]
    size = np.diff(edges)

    held = sorted(range(len(stored)), key=lambda k: ranks[k].astype(">u4").tobytes())
    paths = [ranks[k] for k in held]
    held_size = size[held]
    common = np.zeros(len(held), np.int64)  # length of the path shared with the one before
    for k in range(1, len(held)):
        short = min(len(paths[k]), len(paths[k - 1]))
        differ = np.flatnonzero(paths[k][:short] != paths[k - 1][:short])
        common[k] = differ[0] if len(differ) else short

    walkers = np.array(held) if within else np.arange(len(stored), len(sets))
    out_held, out_walk = [], []
    step = max(1, CELLS // max(1, useful))
    for base in range(0, len(walkers), step):
        part = walkers[base : base + step]
        has = np.zeros((len(part), useful), np.uint8)
        for row, k in enumerate(part):
            has[row, ranks[k]] = 1
        flat = np.concatenate([ranks[k] + row * (useful + 1) for row, k in enumerate(part)])
        begin = np.concatenate(([0], np.cumsum([len(ranks[k]) for k in part])))
        n = size[part]
        # Node: stored sets lo..hi share the first ``depth`` shingles; some walkers are left.
        stack = [(0, len(held), 0, np.arange(len(part)), np.zeros(len(part), np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            if within:  # a pair is met once, by the later of the two
                later = alive + base > lo
                alive, overlap = alive[later], overlap[later]
            if len(alive) == 0:
                continue
            deep = len(paths[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            path = paths[lo][depth:deep]
            if len(path):
                overlap = overlap + has[np.ix_(alive, path)].sum(axis=1, dtype=np.int64)
                passed = np.searchsorted(flat, alive * (useful + 1) + path[-1], "right") - begin[alive]
            else:
                passed = overlap
            most = held_size[lo:hi].max() - deep
            left = np.minimum(most, n[alive] - passed)
            able = (SHARE + OF) * (overlap + left) >= SHARE * (n[alive] + held_size[lo:hi].min())
            alive, overlap = alive[able], overlap[able]
            if len(alive) == 0:
                continue
            # Several sets may end here: they differ in what only they have.
            start = lo
            while start < hi and len(paths[start]) == deep:
                similar = (SHARE + OF) * overlap >= SHARE * (n[alive] + held_size[start])
                found = alive[similar]
                if within:
                    found = found[found + base > start]
                out_held.append(np.full(len(found), held[start]))
                out_walk.append(part[found])
                start += 1
            if start < hi:
                cuts = [start, *(start + 1 + np.flatnonzero(common[start + 1 : hi] <= deep)).tolist(), hi]
                stack += [(a, b, deep, alive, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if not out_held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_held), np.concatenate(out_walk) - (0 if within else len(stored))


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of links and a spanning forest for each pair of blocks; rows come sorted by it."""

    def rows():
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")), strict=True)
            blocks, copies = batch.column("block").to_pylist(), batch.column("copies").to_pylist()
            for key, (_, own), block, count in zip(keys, shingle_sets(batch), blocks, copies, strict=True):
                yield key, block, count, own

    for (_, low, high), group in groupby(rows(), key=lambda r: r[0]):
        sides: tuple[dict, dict] = {}, {}
        for _, block, count, own in group:
            sides[int(block != low)][signature(own)] = count, own
        signs = [*sides[0], *sides[1]]
        weight = np.array([c for side in sides for c, _ in side.values()], np.int64)
        left, right = ([own for _, own in side.values()] for side in sides)
        if low == high:
            a, b = tree_links(left) if len(left) > 1 else (np.empty(0, np.int64),) * 2
        elif left and right:
            a, b = tree_links(left, right)
            b = b + len(left)
        else:
            continue
        total = np.zeros(len(signs), np.int64)
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])
        label = np.arange(len(signs))
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if np.array_equal(before, label):
                break
        linked = np.flatnonzero(total)
        yield pa.record_batch(
            [
                pa.array([signs[k] for k in linked], pa.binary()),
                pa.array(total[linked]),
                pa.array(_least_signs([signs[k] for k in linked], label[linked].tolist()), pa.binary()),
            ],
            names=["sig", "links", "root"],
        )


def similar_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, n_links, component_id, sig.

    ``docs`` has doc_id and text; other columns are ignored. Documents are linked if
    100 times the common shingles are 75 times all of theirs or more. ``n_links`` counts the
    other rows a row is linked with, copies included; ``component_id`` is the least doc_id
    that links lead to. A text of fewer than five words is one shingle; one without words,
    or NULL, has none and is linked with nothing. Repeated rows are linked with each other
    like any copies. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    found = land(map_batches(texts, profile, PROFILE), "jaccard_profile")
    own = found.where("kind = 0").select("doc_id", "text_hash", "n", "sig")

    counts = (
        found.where("kind = 1").groupBy("doc_id").agg(F.sum("n_docs").alias("n_docs")).orderBy(F.desc("n_docs"), "doc_id")
    )
    common = sorted((np.uint64(r.doc_id % (1 << 64)), r.n_docs) for r in counts.limit(ORDERED).collect())
    order = np.array([t for t, _ in common], np.uint64), np.array([c for _, c in common], np.int64)
    shared = spark.sparkContext.broadcast(order)

    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(6, -(-total // (OF * BUCKET_SHINGLES)))
    postings = map_batches(texts.select("text"), _postings(shared, buckets), POSTINGS)
    shared_keys = map_batches(
        postings.repartition(SPREAD * buckets, "bucket").sortWithinPartitions("bucket"), groups, GROUPS
    )
    members = land(shared_keys, "jaccard_groups", compression="zstd").distinct()
    maps = found.where("bits IS NOT NULL").select("sig", "n", "bits").dropDuplicates(["sig"])
    # Neither side is broadcast, however small it is: both grow with the corpus.
    met = members.join(maps.hint("merge"), F.expr("ref = substring(sig, 1, 8)"))
    ties = map_batches(
        met.select("grp", "sig", "n", "bits").repartition("grp").sortWithinPartitions("grp"), candidates, EDGES
    )
    clusters = components(land(ties, "jaccard_candidates"))

    # A set's text is found by id and text, as rows may share an id or have none.
    named = "CASE WHEN doc_id IS NOT NULL THEN struct(doc_id, text_hash) END"
    nodes = own.where("n > 0").groupBy("sig").agg(
        F.count("*").alias("copies"),
        F.expr(f"coalesce(min({named}), min(struct(doc_id, text_hash)))").alias("r"),
        F.max("n").alias("n"),
    ).selectExpr("sig", "copies", "r.doc_id AS least", "r.text_hash AS text", "n")
    placed = land(
        clusters.join(nodes, clusters["node"] == nodes["sig"]).select(
            "sig", "copies", "least", F.col("text").alias("least_text"), "n", F.col("root").alias("cluster")
        ),
        "jaccard_clusters",
    )
    # Blocks of a cluster are dealt by signature; each pair of blocks is a task's group.
    split = placed.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s")).selectExpr(
        "cluster AS _cluster", f"CAST(greatest(ceil(m / {BLOCK_SETS}), ceil(s / {BLOCK_SHINGLES})) AS INT) AS blocks"
    )
    members = (
        placed.join(split, F.expr("cluster = _cluster"))
        .selectExpr("sig", "copies", "least", "least_text", "cluster", "blocks", "pmod(hash(sig), blocks) AS block")
        .selectExpr("*", "explode(sequence(0, blocks - 1)) AS _other")
        .selectExpr(
            "least", "least_text", "copies", "cluster", "block", "least(block, _other) AS low", "greatest(block, _other) AS high"
        )
    )
    # The members grow with the corpus: no broadcast, however small they are.
    sets = texts.join(members.hint("merge"), F.expr("doc_id <=> least AND text_hash = least_text"))
    grouped = (
        sets.select("cluster", "low", "high", "block", "copies", "text")
        .repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high")
    )
    pairs = land(map_batches(grouped, links, LINKS), "jaccard_links")
    roots = components(pairs.selectExpr("sig AS a", "root AS b"))

    sums = pairs.groupBy("sig").agg(F.sum("links").alias("links"))
    labels = sums.join(roots, sums["sig"] == roots["node"], "left").select(
        sums["sig"].alias("_sig"), "links", "root"
    )
    joined = nodes.join(labels, F.expr("sig = _sig"), "left").selectExpr(
        "sig AS _node", "copies", "least", "coalesce(links, 0L) AS links", "coalesce(root, sig) AS root"
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    known = joined.join(least, F.expr("root = _root"))
    return own.join(known, F.expr("sig = _node"), "left").selectExpr(
        "doc_id",
        "text_hash",
        "n AS n_shingles",
        "coalesce(copies - 1 + links, 0L) AS n_links",
        "CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id",
        "root",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each component, by doc_id, with all columns of ``docs``.

    Documents without words stay. Of repeated rows one stays.
    """
    path = fresh_path(docs.sparkSession, "jaccard_components")
    with landing(docs.sparkSession):
        found = land(similar_documents(docs), "jaccard_components", path=path)
    kept = (
        found.where("n_shingles > 0")
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("_of"))
        .selectExpr("_of", "true AS _single")
    )
    empty = found.where("n_shingles = 0").select(F.struct("doc_id", "text_hash").alias("_of"), F.lit(False).alias("_single"))
    # Structs are equal if both ids are missing, and numbering by a key of the join itself moves no row again.
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    chosen = rows.join(kept.unionByName(empty.distinct()), F.expr("_key = _of")).selectExpr(
        "_row", "_single", "row_number() OVER (PARTITION BY _of ORDER BY _single) AS _n"
    )
    return chosen.where("_n = 1 OR NOT _single").select("_row.*")
