import re
from collections import Counter, defaultdict

import pytest

from salescope.llm import mixing


def goals(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


@pytest.fixture(scope="module")
def rows(prose):
    made = [(i, prose(1 + i * 7 % 60, i), "en", ("b", "a", "é", None, "Z")[i % 5]) for i in range(600)]
    made += [(1000 + i, prose(40, i), "en", "hot") for i in range(500)]
    return [*made, (2000, None, "en", "a"), (2001, "", "en", "none"), (2002, " \n", None, None)]


def test_targets_and_words_taken(documents, rows):
    got = mixing.mix(documents(rows, extra=True)).selectExpr("_row.doc_id", "_row.source", "size", "source_size", "target", "taken", "copies").collect()
    texts = {r[0]: r[1] for r in rows}
    sizes, taken = defaultdict(int), Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.taken == r.copies * r.size <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    expected = goals(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source], abs=1e-6)
    for source, goal in expected.items():
        assert abs(taken[source] - goal) <= 60, source


def test_whole_epochs_come_first_and_reruns_agree(documents, rows):
    one = mixing.mix(documents(rows)).selectExpr("_row.doc_id", "_row.source", "copies", "size").collect()
    two = mixing.mix(documents(rows[::-1]).repartition(7)).selectExpr("_row.doc_id", "_row.source", "copies", "size").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
    by = defaultdict(set)
    for r in one:
        if r.size:
            by[r.source].add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_better_documents_are_drawn_more_often(documents, prose):
    docs = [(i, prose(20, i), "en", "b") for i in range(400)] + [(1000 + i, prose(20, i).upper(), "en", "b") for i in range(400)]
    docs += [(5000 + i, prose(20, i), "en", "a") for i in range(100)]
    got = mixing.mix(documents(docs)).selectExpr("_row.doc_id AS d", "copies").collect()
    plain = sum(r.copies for r in got if r.d < 400)
    capital = sum(r.copies for r in got if 1000 <= r.d < 5000)
    assert plain > capital


def test_rows_of_the_mix(documents, rows):
    docs = documents(rows, extra=True)
    mixed = mixing.mixed(docs)
    want = {r.d: r.copies for r in mixing.mix(docs).selectExpr("_row.doc_id AS d", "copies").collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == want


def test_empty_table_and_texts_without_words(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([None, ""])).collect()] == [0, 0]
    assert mixing.mixed(documents([])).count() == 0


def test_draw_equals_sorting_all_keys(documents, prose):
    poor = [(i, prose(3 + i % 50, i).upper() + " 1234567890" * 9, "en", ("a", "b", "c")[i % 3]) for i in range(900)]
    rows = [*poor, *((2000 + i, prose(20, i), "en", ("a", "c")[i % 2]) for i in range(300))]
    docs = documents(rows)
    places = {r.doc_id: (r.place, r.quality) for r in mixing.sized(docs).collect()}
    assert sum(q <= 0.2 for _, q in places.values()) > 800 and len({p for p, _ in places.values()}) == len(rows)
    got = mixing.mix(docs).selectExpr("_row.doc_id AS d", "_row.source AS s", "size", "source_size", "target", "copies").collect()
    drawn = 0
    for source in "abc":
        own = sorted((places[r.d][0], r.d, r) for r in got if r.s == source)
        rest, total = own[0][2].target % own[0][2].source_size, 0
        for place, doc, r in own:
            more = r.copies - int(r.target // r.source_size)
            nearer = total + r.size <= rest or total + r.size - rest < rest - total
            assert more == int(total < rest and nearer), (source, place, doc)
            total += r.size
            drawn += more
    assert 100 < drawn < 1100
