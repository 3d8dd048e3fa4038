import re
from collections import Counter, defaultdict

from salescope.llm import divergence


def brute(rows):
    docs = [(lang or "", source or "", text or "") for text, lang, source in rows]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), text) for _, _, text in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text) for text in low]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), own in zip(docs, terms, strict=True):
        seen[lang].update(set(own))
        counts[lang, source].update(own)
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def chances(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        q = chances(whole)
        for source, count in groups.items():
            p = chances(count)
            pairs = []
            for item, other in groups.items():
                if item != source:
                    o = chances(other)
                    pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), item.encode(), item))
            best = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:200])):
                out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    if extra:
        for name in ("doc_id", "term", "n", "docs", "whole", "head", "item", "value", "rank", "part", "cell", "total"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return sorted(map(tuple, divergence.audit_sources(df).collect()))


def test_hard_texts_match_brute_force(spark, hard_texts):
    rows = []
    for k, text in enumerate(hard_texts * 3):
        rows.append((text, ("en", "fr", None)[k % 3], ("web", "books", None, "é", "z")[k % 5]))
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("once only", "yy", "a"), ("12 ___ 3", "en", "digits only")]
    assert found(spark, rows) == brute(rows)


def test_equal_values_are_ranked_by_bytes_to_the_last_rank(spark):
    # 900 terms have equal counts: one cell reaches beyond the last rank.
    names = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrsü" for c in "tuvwxyz本é"]
    rows = [(" ".join(names[k::2]), "en", "one") for k in (0, 1)] * 2
    rows += [(" ".join(names), "en", "one"), ("common word " * 40 + names[3], "en", "two")]
    rows += [("common word", "en", "two")] * 2 + [("common word common", "en", "one")]
    assert found(spark, rows) == brute(rows)
    assert max(r[5] for r in brute(rows)) == 200


def test_texts_in_small_pieces(spark, prose, monkeypatch):
    monkeypatch.setattr(divergence, "TOGETHER", 300)
    rows = [(prose(10 + 7 * k, k), "de", f"s{k % 6}") for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_source_alone(spark):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en", "s")] * 2) == []
    assert found(spark, [(None, None, None), ("", "", "s")]) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
