"""MinHash near-duplicates with odd sketches.

A document is the set of its three-word shingles. 96 hash functions each keep their least
value over the set; two sets agree in a sample with the probability of their similarity. Groups of
four samples are the keys of 24 bands, by which candidates meet: sets at the least similarity of
0.85 share no band once in 50 million pairs, more similar ones far less often. The samples are
also folded into an odd sketch, a bitmap in which each flips the bit it falls on. What two sets have
in common cancels out in the XOR of their sketches, so its population count is at most twice the
number of samples in which they differ. A candidate whose count is beyond what a linked pair
reaches once in 10^9 is dropped; all others are confirmed on their full sets.

No pair within a group becomes a row, and no group has to meet in one task:

1. Documents with equal sets are one node.
2. Per band key, only its least node is paired with the others (a join, which may be split). What the
   sketches let pass is confirmed in tasks of a leader and a bounded block of its nodes. This
   puts the copies of one original in one component, whatever their number.
3. Of the band keys only those are left whose nodes are in several components. There all
   nodes of different components are compared by sketch, in blocks where they are many; what passes ties
   clusters, and each pair of blocks of a cluster is confirmed in a task, unless already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.components import components
from salescope.llm.words import BY_SPACE, gram_hash, hashed_words, mix, pieces, text_buffers
from salescope.llm.workers import map_batches
from salescope.sources.shared import land

# Shingle size and least similarity in hundredths.
SHINGLE, SIMILAR = 3, 85

#: Samples in a band, and bands.
ROWS, BANDS = 4, 24
#: Bits of an odd sketch.
BITS = 512
#: A linked pair may be beyond the sketches' limit with this probability at most.
LOST = 1e-9
#: Sets and shingles that one task confirms at a time.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Nodes of a band key that one task compares by sketch.
MEET = 2048

_random = np.random.Generator(np.random.PCG64(8_512))
_SCALE = _random.integers(1 << 62, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_SAMPLE = _random.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64)

PROFILE = "doc_id long, text_hash long, n long, sig binary, sketch array<bigint>, bands array<bigint>"
EDGES = "a binary, b binary"


def shingles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles of a piece of the texts, one text after the other and repeats included, and where each starts."""
    data, offsets = text_buffers(batch.column("text"))
    for low, high in pieces(offsets):
        words, first = hashed_words(
            data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], BY_SPACE
        )
        size = np.diff(first)
        count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
        edges = np.concatenate(([0], np.cumsum(count)))
        own = np.zeros(edges[-1], np.uint64)
        whole = np.flatnonzero(size >= SHINGLE)
        at = np.repeat(first[:-1][whole] - edges[:-1][whole], count[whole])
        to = np.repeat(size >= SHINGLE, count)
        own[to] = gram_hash(words, SHINGLE)[np.flatnonzero(to) + at]
        for k in np.flatnonzero((size > 0) & (size < SHINGLE)).tolist():
            own[edges[k]] = gram_hash(words[first[k] : first[k + 1]], int(size[k]))[0]
        yield own, edges


def distinct(own: np.ndarray) -> np.ndarray:
    own = np.sort(own)
    return own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def signature(own: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    one, two = mix(own ^ np.uint64(0x3C79AC492BA7B653)).sum(), mix(own + np.uint64(0x1C69B3F74AC4AE35)).sum()
    return mix(np.array([one + np.uint64(len(own)), two], np.uint64)).tobytes()


def samples(own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Least value of every hash function over each of some sets, none of them empty."""
    out = np.empty((len(edges) - 1, len(_SCALE)), np.uint64)
    for k, (scale, shift) in enumerate(zip(_SCALE, _SHIFT, strict=True)):
        out[:, k] = np.minimum.reduceat(own * scale + shift, edges[:-1])
    return out


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """Bitmaps in 64-bit words. A bit is set if an odd number of samples falls on it."""
    at = (mix(found + _SAMPLE) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flat = at + np.arange(len(found))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(found) * BITS).reshape(len(found), BITS) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key of each band, other ones for other bands."""
    parts = mix(found + _SAMPLE).reshape(len(found), BANDS, ROWS)
    turned = (parts * _SAMPLE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mix(turned).view(np.int64)


@cache
def most_differing() -> int:
    """The largest XOR count that a linked pair reaches, but for ``LOST`` of them."""
    total, p, lost, agree = ROWS * BANDS, SIMILAR / 100, 0.0, 0
    while (lost := lost + comb(total, agree) * p**agree * (1 - p) ** (total - agree)) <= LOST:
        agree += 1
    return 2 * (total - agree)


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature, sketch and band keys of each document."""
    for batch in batches:
        low = 0
        for own, edges in shingles(batch):
            count = len(edges) - 1
            filled = np.flatnonzero(np.diff(edges))
            sets = [distinct(own[edges[k] : edges[k + 1]]) for k in range(count)]
            sketch, keys = [None] * count, [None] * count
            if len(filled):
                found = samples(own, np.append(edges[filled], edges[-1]))
                for k, bits, bands in zip(filled.tolist(), odd_sketches(found), band_keys(found), strict=True):
                    sketch[k], keys[k] = bits.view(np.int64), bands
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(low, count),
                    batch.column("text_hash").slice(low, count),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(sketch, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n", "sig", "sketch", "bands"],
            )
            low += count


class _Forest:
    """Which of some nodes are known to be connected."""

    def __init__(self, labels: list):
        first: dict = {}
        self.parent = np.array([first.setdefault(label, k) for k, label in enumerate(labels)], np.int64)

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = int(self.parent[k])
        return k

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return above
            self.parent = above

    def tie(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _apart(one: int, others: np.ndarray, sizes, sketches, forest: _Forest) -> np.ndarray:
    """Those of ``others`` that may be linked with ``one`` and are not yet connected with it in ``forest``."""
    others = others[forest.roots()[others] != forest.root(one)]
    n, m = sizes[one], sizes[others]
    others = others[100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m)]
    differ = np.bitwise_count(sketches[others] ^ sketches[one]).sum(axis=1, dtype=np.int64)
    return others[differ <= most_differing()]


def _stars(forest: _Forest, names: list[bytes]) -> pa.RecordBatch:
    """Edges from the names of connected nodes to the least of them."""
    edges = set()
    roots = forest.roots()
    order = np.argsort(roots, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
        if len(own) > 1:
            least = min(names[k] for k in own)
            edges.update((names[k], least) for k in own if names[k] != least)
    a, b = zip(*sorted(edges), strict=True) if edges else ((), ())
    return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect all pairs of a band key that may be linked and are in different components.

    Rows come sorted by key and block.
    """

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in MEETING), strict=True)

    for (_, low, high), group in groupby(rows(), key=lambda r: r[:3]):
        nodes = {r[4]: r for r in group}
        number = {label: k for k, label in enumerate({r[7] for r in nodes.values()})}
        if len(number) < 2:
            continue
        signs, block = list(nodes), np.array([r[3] for r in nodes.values()])
        sizes, sketches = np.array([r[5] for r in nodes.values()]), np.array([r[6] for r in nodes.values()], np.int64).view(np.uint64)
        component = np.array([number[r[7]] for r in nodes.values()])
        forest = _Forest(signs)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for k in left.tolist():
            others = right if low != high else right[right > k]
            others = others[component[others] != component[k]]
            for other in _apart(k, others, sizes, sketches, forest).tolist():
                forest.tie(k, other)
        yield _stars(forest, signs)


MEETING = ("key", "low", "high", "block", "sig", "n", "sketch", "label")
CONFIRMING = ("key", "low", "high", "block", "label")


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the labels of linked sets; rows come sorted by key and block.

    Sets of one label are known to be connected. The sketches choose which others are compared.
    """

    def rows():
        for batch in batches:
            facts = zip(*(batch.column(c).to_pylist() for c in CONFIRMING), strict=True)
            for own, edges in shingles(batch):
                # The whole piece's samples at once; each text's set is sorted on its own.
                filled = np.flatnonzero(np.diff(edges))
                bits = odd_sketches(samples(own, np.append(edges[filled], edges[-1]))) if len(filled) else []
                sketch = dict(zip(filled.tolist(), bits, strict=True))
                for k in range(len(edges) - 1):
                    fact = next(facts)
                    if k in sketch:
                        yield fact, distinct(own[edges[k] : edges[k + 1]]), sketch[k]

    for (_, low, high), group in groupby(rows(), key=lambda r: r[0][:3]):
        nodes = {signature(own): (fact, own, bits) for fact, own, bits in group}
        facts = [fact for fact, _, _ in nodes.values()]
        sets, sketches = [own for _, own, _ in nodes.values()], np.stack([bits for _, _, bits in nodes.values()])
        sizes, block = np.array([len(s) for s in sets]), np.array([f[3] for f in facts])
        forest = _Forest([f[4] for f in facts])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for k in left.tolist():
            others = right if low != high else right[right > k]
            for other in _apart(k, others, sizes, sketches, forest).tolist():
                if forest.root(k) != forest.root(other):
                    common = len(sets[k]) + len(sets[other]) - len(distinct(np.concatenate((sets[k], sets[other]))))
                    if 100 * common >= SIMILAR * (len(sets[k]) + len(sets[other]) - common):
                        forest.tie(k, other)
        yield _stars(forest, [f[4] for f in facts])


def _confirmed(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges of ``confirm`` for groups of least, text_hash and what it reads."""
    wanted = groups.withColumnsRenamed({"least": "_least", "text_hash": "_text_hash"})
    # The nodes grow with the corpus: no broadcast, however few they are.
    sets = texts.join(wanted.hint("merge"), F.expr("doc_id <=> _least AND text_hash = _text_hash"))
    keys = ["key", "low", "high"]
    grouped = sets.select("text", *CONFIRMING).repartition(*keys).sortWithinPartitions(*keys)
    return land(map_batches(grouped, confirm, EDGES), "minhash_links")


def _blocks(groups: DataFrame, key: str) -> DataFrame:
    """Blocks that a key's nodes are dealt to."""
    return groups.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("s")).selectExpr(
        f"{key} AS _{key}", f"CAST(greatest(ceil(m / {BLOCK_SETS}), ceil(s / {BLOCK_SHINGLES})) AS INT) AS blocks"
    )


#: Every node goes to each pair of blocks that its own is part of.
_PAIRED = ("pmod(hash(sig), blocks) AS block", "explode(sequence(0, blocks - 1)) AS _other")
_PAIR = ("least(block, _other) AS low", "greatest(block, _other) AS high")


def near_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id, kept, root.

    ``docs`` has doc_id and text; other columns are ignored. Documents are linked if 100 times the common
    shingles are 85 times all of theirs or more. ``component_id`` is the least doc_id that links lead to, and
    ``kept`` tells if that is the document's own. A text of fewer than three words is one shingle; one without words,
    or NULL, has none and is linked with nothing. Rows with equal texts are linked, also under one doc_id; then each
    of them is kept. A NULL doc_id is no least one unless there is no other in the component; it counts as
    equal to NULL. An empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    found = land(map_batches(texts, profile, PROFILE), "minhash_profile")
    own = found.select("doc_id", "text_hash", "n", "sig")
    # min leaves out structs that are NULL, so a row with an id is a set's representative if there is one.
    named = "CASE WHEN doc_id IS NOT NULL THEN struct(doc_id, text_hash) END"
    nodes = land(
        found.where("n > 0").groupBy("sig").agg(
            F.expr(f"coalesce(min({named}), min(struct(doc_id, text_hash)))").alias("r"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
            F.first("bands").alias("bands"),
        ).selectExpr("sig", "r.doc_id AS least", "r.text_hash AS text_hash", "n", "sketch", "bands"),
        "minhash_nodes",
    )
    keyed = nodes.selectExpr("sig", "explode(bands) AS band")

    # The least node of each band key that several have, and the nodes that it meets there.
    shared = keyed.groupBy("band").agg(F.min("sig").alias("leader"), F.count("*").alias("m")).where("m > 1")
    members = land(keyed.join(shared, "band"), "minhash_members")
    stars = members.where("sig <> leader").select("sig", "leader").distinct()
    facts = nodes.select("sig", "least", "text_hash", "n", "sketch")
    led = facts.selectExpr("sig AS leader", "n AS _n", "sketch AS _sketch")
    differ = " + ".join(f"bit_count(sketch[{k}] ^ _sketch[{k}])" for k in range(BITS // 64))
    likely = land(
        stars.join(facts, "sig").join(led, "leader")
        .where(f"100 * least(n, _n) >= {SIMILAR} * greatest(n, _n) AND {differ} <= {most_differing()}")
        .select("sig", "leader", "least", "text_hash", "n"),
        "minhash_stars",
    )
    dealt = likely.join(_blocks(likely, "leader"), F.expr("leader = _leader"))
    heads = dealt.selectExpr("leader AS sig", "leader AS key", "blocks").distinct().join(facts, "sig").selectExpr(
        "sig", "key", "least", "text_hash", "explode(sequence(0, blocks - 1)) AS block"
    )
    groups = dealt.selectExpr("sig", "leader AS key", "least", "text_hash", "pmod(hash(sig), blocks) AS block").unionByName(heads)
    first = _confirmed(groups.selectExpr("least", "text_hash", "key", "block AS low", "block AS high", "block", "sig AS label"), texts)
    reached = land(components(first), "minhash_components")

    # Band keys whose nodes are in several components by now.
    labels = land(
        facts.join(reached.selectExpr("node AS sig", "root"), "sig", "left").selectExpr(
            "sig", "least", "text_hash", "n", "sketch", "coalesce(root, sig) AS label"
        ),
        "minhash_labels",
    )
    placed = members.select("band", "sig").join(labels.select("sig", "label"), "sig")
    mixed = placed.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("m")).where(
        "_low <> _high"
    ).selectExpr("band AS key", f"CAST(ceil(m / {MEET}) AS INT) AS blocks")
    meeting = (
        members.selectExpr("band AS key", "sig").join(mixed, "key").join(labels, "sig")
        .selectExpr("key", "sig", "n", "sketch", "label", *_PAIRED)
        .selectExpr("key", *_PAIR, "block", "sig", "n", "sketch", "label")
    )
    keys = ["key", "low", "high"]
    ties = land(
        map_batches(meeting.select(*MEETING).repartition(*keys).sortWithinPartitions(*keys), meet, EDGES), "minhash_ties"
    )
    clusters = components(ties)
    left = land(clusters.selectExpr("node AS sig", "root AS cluster").join(labels.drop("sketch"), "sig"), "minhash_clusters")
    split = left.join(_blocks(left, "cluster"), F.expr("cluster = _cluster"))
    paired = split.selectExpr("least", "text_hash", "sig", "label", "cluster AS key", "blocks", *_PAIRED).selectExpr(
        "least", "text_hash", "label", "key", *_PAIR, "block"
    )
    ends = components(_confirmed(paired, texts)).selectExpr("node AS _label", "root")
    known = labels.select("sig", "least", "label").join(ends, F.expr("label = _label"), "left").selectExpr(
        "sig AS _node", "least", "coalesce(root, label) AS root"
    )
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    joined = known.join(smallest, F.expr("root = _root"))
    return own.join(joined, F.expr("sig = _node"), "left").selectExpr(
        "doc_id",
        "text_hash",
        "n AS n_shingles",
        "CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id",
        "n = 0 OR doc_id <=> component_id AS kept",
        "root",
    )
