import re

import pytest

from salescope.llm import urls


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://net/", "http://net", "https://xnet/", "ftp://e.example.net/en/1?u=://z",
    "http://example.net/en/", "http://example.net/EN/1", "http://b.example.com/de/9#top", "http://notexample.com/de/9",
    "x://a.org/fr/1", "x://a.org/fr", "http://ÜBER.org/fr/é", "http://a.com?x=/de/", "http://a.com#/de/", "a://b://c/d", "http://a\nb.net/x\ny",
]


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS node", "'z' AS s0")

    return build


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")


def test_rules_match_brute_force(pages, labels):
    rows = urls.filter_urls(pages([*enumerate(URLS), (3, URLS[3])]), labels([])).collect()
    assert len(rows) == len(URLS) + 1
    said = {h + p: v for h, p, v in urls.RULES}
    for r in rows:
        expected = rule_of(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == expected, URLS[r.page_id]
        assert r.verdict == (said[r.rule] if r.rule else "allow")


def test_bad_branch_is_a_template_of_its_own(pages, labels):
    rows = [(i, f"http://a.com/{('news', 'spam', 'blog')[i % 3]}/{i}/x{i}") for i in range(300)]
    rows += [(1000 + i, f"http://b.com/{i}") for i in range(3)]
    rows += [(2000 + i, f"http://c.com/{'uv'[i % 2]}/{i}") for i in range(80)]
    quality = [(i, 0 if i % 3 == 1 else 1) for i in range(300)] + [(1000, 0), (1001, 0)]
    quality += [(2000 + i, int(i % 5 > 0)) for i in range(80)]
    found = {r.page_id: r for r in urls.filter_urls(pages(rows), labels([*quality, (5, 1), (7, None)])).collect()}
    assert {found[i].verdict for i in range(0, 300, 3)} == {"allow"}
    assert {found[i].verdict for i in range(1, 300, 3)} == {"block"}
    assert found[1].template == "/spam/*/*"
    # Alike branches are one template, and two labels prove nothing.
    assert found[2000].template == found[2001].template == "/*/*"
    assert found[1002].verdict == "allow" and found[1002].purity > 0.5


def test_empty_tables(pages, labels):
    assert urls.filter_urls(pages([]), labels([(1, 1)])).count() == 0


def test_branches_below_the_third_segment_are_told_apart(pages, labels):
    rows = [(i, f"http://a.com/a/b/c/{('news', 'spam', 'blog')[i % 3]}/x/y/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://b.com/p/q/r/s/t/{'uv'[i % 2]}") for i in range(100)]
    rows += [(2000 + i, f"http://c.com/a/b/c/d/e/page{'/more' * i}") for i in range(3)]
    rows += [(3000 + i, "http://b.com/p/q") for i in range(3)]
    quality = [(i, 0 if i % 3 == 1 else 1) for i in range(300)] + [(1000 + i, 1 - i % 2) for i in range(100)]
    found = {r.page_id: r for r in urls.filter_urls(pages(rows), labels(quality)).collect()}
    assert {found[i].verdict for i in range(300) if i % 3 != 1} == {"allow"}
    assert {found[i].verdict for i in range(1, 300, 3)} == {"block"}
    assert found[1].template == "/*/*/*/spam/*/*/*"
    assert [found[1000 + i].verdict for i in range(4)] == ["allow", "block"] * 2
    assert found[1001].template == "/*/*/*/*/*/v"
    # Few labels are merged at every depth, and each segment is in the template.
    assert [found[2000 + i].template for i in range(3)] == ["/*" * (6 + i) for i in range(3)]
    assert found[3000].template == "/*/*"
