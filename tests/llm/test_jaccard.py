import random
import re
from collections import defaultdict

import numpy as np
import pytest

from salescope.llm import components, jaccard
from salescope.sources import shared


def brute(texts):
    """n_shingles, component (least position) and number of links of each text."""
    sets = []
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        sets.append(grams if len(words) >= 5 else {tuple(words)} if words else set())
    group, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [(len(s), g, n) for s, g, n in zip(sets, group, links, strict=True)]


def found(df):
    rows = jaccard.similar_documents(df).collect()
    return [(r.n_shingles, r.component_id, r.n_links) for r in sorted(rows, key=lambda r: r.doc_id)]


def edited(text, rate, seed):
    chosen = random.Random(seed)
    return " ".join(w if chosen.random() > rate else f"new{chosen.randrange(9)}" for w in text.split())


def test_hard_texts_match_brute_force(documents, hard_texts):
    assert found(documents(hard_texts, extra=True)) == brute(hard_texts)


@pytest.mark.parametrize("split", [None, 7])
def test_chains_of_near_copies_match_brute_force(documents, prose, monkeypatch, split):
    if split:  # common shingles and clusters in several blocks
        monkeypatch.setattr(jaccard, "SPLIT", split)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 11)
    texts = []
    for seed in range(4):
        text = prose(80 + 40 * seed, seed)
        for step in range(14):
            texts.append(text)
            text = edited(text, 0.012, 100 * seed + step)
    texts += [prose(30, 50) + " " + prose(60, 60 + k) for k in range(20)]  # a shared passage alone
    assert found(documents(texts)) == brute(texts)


def test_tree_finds_the_pairs_of_a_plain_comparison():
    chosen = np.random.Generator(np.random.PCG64(5))
    sets = [np.unique(chosen.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(s[chosen.random(len(s)) > 0.1], chosen.integers(0, 99, 2).astype(np.uint64))) for s in sets]
    sets = list({s.tobytes(): s for s in sets}.values())

    def similar(a, b):
        common = len(np.intersect1d(a, b))
        return 100 * common >= 75 * (len(a) + len(b) - common)

    plain = {(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])}
    assert plain
    a, b = jaccard.tree_links(sets)
    assert {tuple(sorted(p, reverse=True)) for p in zip(a.tolist(), b.tolist(), strict=True)} == plain and len(a) == len(plain)
    left, right = sets[:50], sets[50:]
    a, b = jaccard.tree_links(left, right)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(j, i - 50) for i, j in plain if j < 50 <= i}


def test_one_of_each_group_stays(documents, hard_texts):
    rows = [(i, t) for i, t in enumerate(hard_texts)] + [(7, hard_texts[7]), (0, None)]
    kept = sorted(r.doc_id for r in jaccard.keep_one(documents(rows, extra=True)).collect())
    firsts = {g for _, g, _ in brute(hard_texts)}
    assert kept == sorted([*firsts, 0])  # both rows without a text stay, of the repeated row one


def test_empty_table(documents):
    assert found(documents([])) == []
    assert jaccard.keep_one(documents([])).count() == 0


def test_components_of_paths_and_stars(spark):
    chosen = random.Random(3)
    nodes = list(range(300))
    chosen.shuffle(nodes)
    edges = list(zip(nodes[:100], nodes[1:101], strict=False)) + [(nodes[150], n) for n in nodes[151:200]]
    group = {n: n for n in nodes}
    members = defaultdict(set)
    for a, b in [*edges, (5, 5)]:
        low, high = sorted((group[a], group[b]))
        group = {n: low if g == high else g for n, g in group.items()}
        members[0] |= {a, b} if a != b else set()
    df = spark.createDataFrame([*edges, (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components.components(df).collect()} == {n: group[n] for n in members[0]}


def test_rows_without_an_id_or_with_the_same_one(documents, prose):
    one, two = prose(100, 1), prose(100, 2)
    texts = [one, edited(one, 0.01, 1), one, two, edited(two, 0.01, 2)]
    expected = sorted(n for _, _, n in brute(texts))
    assert expected == [1, 1, 2, 2, 2]
    for ids in ([None] * 5, [4] * 5, [7, None, 7, None, 7]):
        rows = jaccard.similar_documents(documents(list(zip(ids, texts, strict=True)))).collect()
        assert sorted(r.n_links for r in rows) == expected, ids
    assert {r.component_id for r in rows} == {7}


def test_postings_do_not_grow_with_the_number_of_buckets(prose):
    """A document's keys go to any number of buckets, and nothing else of it goes to each of them."""
    import pyarrow as pa

    texts = [prose(600, seed) for seed in range(20)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])

    class Shared:
        value = np.empty(0, np.uint64), np.empty(0, np.int64)

    def moved(buckets):
        rows = list(jaccard._postings(Shared, buckets)(iter([batch])))
        return sum(len(p.as_py()) for r in rows for p in r.column("payload"))

    assert moved(6) == moved(600) == moved(10_000)


def test_groups_name_each_set_of_documents_once():
    import pyarrow as pa

    keys = np.array([5, 5, 6, 6, 7, 8, 8, 8], np.uint64)
    refs = np.array([1, 2, 2, 1, 1, 1, 2, 3], np.uint64)
    half = [jaccard._packed(k, r, 1) for k, r in ((keys[:3], refs[:3]), (keys, refs))]
    rows = [row for batch in jaccard.groups(iter(half)) for row in batch.to_pylist()]
    found = defaultdict(list)
    for row in rows:
        found[row["grp"]].append(int.from_bytes(row["ref"], "little"))
    assert sorted(found.values()) == [[1, 2], [1, 2, 3]]
    assert pa.table({"grp": [r["grp"] for r in rows]}).num_rows == 5


def test_texts_are_moved_once_to_keep_one_of_each_group(spark, documents, hard_texts):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard.keep_one(documents(hard_texts))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan.split("Window")[1].split("SortMergeJoin")[0]


def test_only_the_result_stays_in_the_shared_folder(spark, documents, prose):
    texts = [prose(80, 1), prose(80, 1) + " end", prose(90, 2)]
    with shared.landing(spark):
        before = set(shared._landed.get(spark.sparkContext.applicationId, []))
        assert jaccard.keep_one(documents(texts)).count() == 2
        left = [p.rsplit("/", 1)[1] for p in shared._landed[spark.sparkContext.applicationId] if p not in before]
    assert [name.rsplit("-", 1)[0] for name in left] == ["jaccard_components"]
