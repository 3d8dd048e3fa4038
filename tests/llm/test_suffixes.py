import hashlib
import random

import numpy as np
import pytest

from salescope.llm import suffixes


def brute(texts):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    rows = sorted(suffixes.remove_repeats(df).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_hard_texts_match_brute_force(documents, hard_texts):
    assert found(documents(hard_texts, extra=True)) == brute(hard_texts)


@pytest.mark.parametrize("frequent", [None, 3])
def test_passages_at_all_offsets_match_brute_force(documents, prose, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    chosen = random.Random(8)
    passage, line = prose(60, 1), prose(14, 2)[:70]
    texts = []
    for k in range(60):
        start = chosen.randrange(0, 120)
        piece = passage[start : start + chosen.choice([98, 99, 100, 101, 150, 240])]
        texts.append(f"{line} {prose(chosen.randrange(0, 30), 100 + k)} {piece} {prose(20, 200 + k)}")
    texts += ["ab" * 200, "abc" * 90, "é" * 120, prose(40, 3) * 3]
    assert found(documents(texts).repartition(5)) == brute(texts)


def test_repeated_rows_are_one_document(documents, prose):
    text = prose(60, 4)
    rows = found(documents([(1, text), (1, text), (2, text)]))
    assert [r[1] for r in rows] == [0, 0, len(text.encode())]


def test_missing_id_and_empty_table(documents, prose):
    text = prose(60, 4)
    rows = suffixes.remove_repeats(documents([(None, text), (0, text)])).collect()
    assert {r.doc_id: r.n_removed > 0 for r in rows} == {None: False, 0: True}
    assert found(documents([])) == []


def test_levels_stay_few_and_find_the_earliest():
    chosen = np.random.Generator(np.random.PCG64(1))
    index, flagged, every = suffixes.Levels(), set(), []
    for _ in range(40):
        n = 50
        doc, value = chosen.integers(0, 10**6, n), chosen.integers(0, 700, n).astype(np.uint64)
        zero = np.zeros(n, np.int64)
        every += list(zip(value.tolist(), doc.tolist(), strict=True))
        batch = dict(zip(suffixes.COLUMNS, (value, value + np.uint64(7), doc, zero, zero, zero + 1), strict=True))
        repeated = index.add(batch)
        flagged |= set(zip(repeated["print"].tolist(), repeated["doc"].tolist(), strict=True))
        assert len(index.levels) <= 8
    first = {}
    for value, doc in every:
        first[value] = min(doc, first.get(value, doc))
    assert flagged == {(v, d) for v, d in every if d != first[v]}
