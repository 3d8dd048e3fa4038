import random
import re

import numpy as np
import pytest

from salescope.llm import minhash


def brute(texts):
    """n_shingles and component (least position) of each text."""
    sets = []
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        sets.append(grams if len(words) >= 3 else {tuple(words)} if words else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [(len(s), g, g == k) for k, (s, g) in enumerate(zip(sets, group, strict=True))]


def found(df):
    rows = minhash.near_documents(df).collect()
    return [(r.n_shingles, r.component_id, r.kept) for r in sorted(rows, key=lambda r: r.doc_id)]


def edited(text, rate, seed):
    chosen = random.Random(seed)
    return " ".join(w if chosen.random() > rate else f"new{chosen.randrange(9)}" for w in text.split())


def test_hard_texts_match_brute_force(documents, hard_texts):
    assert found(documents(hard_texts, extra=True)) == brute(hard_texts)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_match_brute_force(documents, prose, monkeypatch, small):
    if small:  # band keys and groups in several blocks
        for name, size in (("MEET", 5), ("BLOCK_SETS", 4)):
            monkeypatch.setattr(minhash, name, size)
    texts = []
    for seed in range(4):  # chains, whose ends are not linked themselves
        text = prose(90 + 50 * seed, seed)
        for step in range(14):
            texts.append(text)
            text = edited(text, 0.012, 100 * seed + step)
    original = prose(100, 20)  # copies of one original, some of them beyond the similarity
    texts += [edited(original, 0.03, 500 + k) for k in range(50)] + [original]
    texts += [prose(60, 50) + " " + prose(30, 60 + k) for k in range(20)]  # a shared passage alone
    assert found(documents(texts)) == brute(texts)


def test_pairs_at_the_least_similarity_are_linked(documents):
    # 17 of 20 shingles: 100 * 17 = 85 * 20; one less in common is too few.
    texts = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(19)]
        texts += [" ".join(words), " ".join([*words, "a", "b", "c"]), " ".join([f"v{k}x{i}" for i in range(18)])]
        texts.append(" ".join([f"v{k}x{i}" for i in range(18)] + ["a", "b", "c"]))
    expected = brute(texts)
    assert sum(not kept for _, _, kept in expected) == 60
    assert found(documents(texts)) == expected


def test_null_and_shared_ids(documents, prose):
    long, near = prose(200, 3), edited(prose(200, 3), 0.005, 1)
    rows = [(None, long), (None, near), (5, long), (5, long), (4, prose(50, 8)), (None, "only here"), (None, None)]
    out = minhash.near_documents(documents(rows)).collect()
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out)
    size = len({tuple(long.split()[i : i + 3]) for i in range(198)})
    other = len({tuple(near.split()[i : i + 3]) for i in range(198)})
    few = len({tuple(prose(50, 8).split()[i : i + 3]) for i in range(48)})
    assert found == sorted(
        [("None", size, "5", False), ("None", other, "5", False), ("5", size, "5", True), ("5", size, "5", True),
         ("4", few, "4", True), ("None", 1, "None", True), ("None", 0, "None", True)]
    )


def test_empty_table(documents):
    assert found(documents([])) == []


def test_sketches_bound_what_samples_differ_in():
    chosen = np.random.Generator(np.random.PCG64(2))
    base = chosen.integers(0, 1 << 63, 400).astype(np.uint64)
    counts = {}
    for share in (0.95, 0.85, 0.5, 0.2):
        common = int(800 * share / (1 + share))
        pairs = []
        for _ in range(40):
            own = chosen.permutation(base)
            fresh = chosen.integers(0, 1 << 63, 400 - common).astype(np.uint64)
            both = np.concatenate([own, own[:common], fresh])
            found = minhash.samples(both, np.array([0, 400, 800]))
            bits = minhash.odd_sketches(found)
            differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert differ <= 2 * int((found[0] != found[1]).sum())
            pairs.append(differ)
        counts[share] = pairs
    most = minhash.most_differing()
    assert max(counts[0.95] + counts[0.85]) <= most < min(counts[0.2])
    assert np.median(counts[0.95]) < np.median(counts[0.85]) < np.median(counts[0.5])
