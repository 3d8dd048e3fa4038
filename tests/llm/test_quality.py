import re
from collections import Counter

from salescope.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_match_brute_force(documents, hard_texts):
    texts = [*hard_texts, "a | b\na | b\n\nc # d <e> 100%\n \n", "a b c a b c a b", "a a a a"]
    rows = quality.quality_rules(documents(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = brute(texts[row.doc_id])
        assert tuple(row[m] for m in quality.MEASURES) == expected, texts[row.doc_id]
        assert row.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (row.base_failed and row.kept)


def test_fences_follow_each_group(documents, prose):
    # In source t tables are usual, in source s they are junk.
    clean = [(i, prose(80, i), "en", "s") for i in range(250)]
    tables = [(1000 + i, prose(80, 1000 + i).replace(" ", "| "), "en", "t") for i in range(250)]
    odd = [(5000, prose(80, 5000).replace(" ", "| "), "en", "s"), (5001, prose(80, 5001).upper(), "en", None)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(documents([*clean, *tables, *odd])).collect()}
    assert all(kept[i] for i in range(250)) and all(kept[1000 + i] for i in range(250))
    assert not kept[5000] and not kept[5001]


def test_sketches_merge(documents, prose):
    rows = quality.measure(documents([(i, prose(60, i) + " #" * (i % 9), "en", "s") for i in range(90)]))
    rows = rows.selectExpr("_row.lang", "_row.source", "_row.doc_id", *quality.RATES)
    whole = quality.sketches(rows)
    parts = [quality.sketches(rows.where(f"doc_id % 3 = {k}")) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "rate", "bucket").sum("n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_buckets_are_narrow_and_rise(spark):
    df = spark.range(0, 3_000_000, 37).selectExpr("id", f"{quality._bucket('id')} AS b")
    assert df.where("b > id OR id - b > id / 64").count() == 0


def test_kept_rows_have_all_columns(documents, hard_texts):
    docs = documents(hard_texts, extra=True)
    kept = quality.keep_good(docs)
    ids = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids


def test_empty_table(documents):
    assert quality.quality_rules(documents([])).count() == 0
    assert quality.keep_good(documents([])).count() == 0
