import hashlib
import re
from collections import defaultdict

import pytest

from salescope.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1) if own else ():
            windows[tuple(own[k : k + size])].add(item)
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for size in range(1, 11):
            for k in range(len(own) - size + 1):
                if names := windows.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        named = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((len(own), len(hit), len(named), digest, bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(prose):
    return [
        (1, prose(40, 1)), (2, "One, two; THREE"), (3, prose(9, 3)), (10, prose(10, 4)), (4, None), (5, "?!"),
        (6, prose(40, 1)), (6, prose(25, 6)), (None, prose(12, 7)), (7, "ünïque"),
    ]


@pytest.fixture(scope="module")
def texts(prose, hard_texts):
    item = prose(40, 1).split()
    return [
        *hard_texts,
        prose(30, 90) + " " + " ".join(item[5:15]) + " " + prose(30, 91),
        prose(30, 90) + " " + " ".join(item[5:14]) + " x " + prose(30, 91),
        "so one two three and ÜNÏQUE ünïque", prose(9, 3), prose(10, 4).upper(), prose(12, 7), " ".join(item * 2),
        prose(40, 6),
    ]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_findings_match_brute_force(spark, documents, texts, items, limit):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(texts, extra=True)
    rows = decontaminate.digest(decontaminate.find_contamination(docs, bench, limit)).orderBy("doc_id").collect()
    expected = brute(texts, items)
    assert [tuple(r)[1:] for r in rows] == expected
    clean = decontaminate.drop_contaminated(docs, bench, limit)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, e in enumerate(expected) if not e[4]]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_repeated_rows_and_empty_tables(spark, documents, prose, limit):
    bench = spark.createDataFrame([(1, prose(12, 1))], "item_id long, text string")
    rows = decontaminate.find_contamination(documents([(1, prose(12, 1))] * 3 + [(1, "x")]), bench, limit).collect()
    assert sorted(r.n_hit for r in rows) == [0, 12, 12, 12]
    assert decontaminate.find_contamination(documents([]), bench, limit).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(documents(["a b"]), none, limit).first().n_hit == 0
