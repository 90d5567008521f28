import pytest

from screenlens.llm.url_filter import RULES, rule_table, url_filter

URLS = [
    "http://a.example.org/es/x?y#z",
    "HTTPS://EXAMPLE.org/en/123",
    "http://example.org/en/2",
    "http://notexample.org/es/1",
    "http://a.com/fr/1",
    "http://a.com/de/1#q",
    "http://com/de/",
    "http://a.com",
    "http://a.org",
    "http://a.org?x",
    "http://a.com/x://y.org/",
    "no scheme here",
    "://",
    "",
    None,
    "http://user@a.org:80/p",
    "http://ÄB.org/\n/x",
    "http://a..b.org/",
    "http://org./",
    "http://org",
    "http://org/",
    "http://a.net/de/",
    "http://" + "l." * 3000 + "org/" + "p" * 50_000,
    "http://a.com/de/1#q",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p or ""), len(h), h + (p or ""), v)
        for v, h, p in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


MORE = [*RULES, ("block", "a.com", "/"), ("allow", "a.com", "/d"), ("block", "b.org", ""), ("block", "", "/"), ("block", None, "/x")]


@pytest.mark.parametrize("rules", [RULES, MORE, [("block", "org", None)]])
def test_matches_brute_force(spark, rows, rules):
    pages = spark.createDataFrame(
        [(i, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, key string, id string"
    )
    got = rows(url_filter(pages, rule_table(spark, rules)), "page_id")
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(URLS)]


def test_empty_tables(spark, rows):
    pages = spark.createDataFrame([(1, "http://a.org/"), (None, "http://a.org/")], "page_id long, url string")
    rules = rule_table(spark, RULES)
    assert rows(url_filter(pages.limit(0), rules)) == []
    assert [r[3:] for r in rows(url_filter(pages, rules.limit(0)))] == [(None, "allow")] * 2
    assert [r[3:] for r in rows(url_filter(pages, rules))] == [("org/", "allow")] * 2


def test_many_rules_and_one_hot_url(spark, rows):
    rules = [("block", f"h{i % 7}.net", "/" + "ab"[: i % 3] * (i % 5)) for i in range(60)] + [("allow", "net", "/")]
    urls = [f"http://w{i % 3}.h{i % 9}.net/{'ab' * (i % 4)}" for i in range(200)] + ["http://x.h1.net/abab"] * 100
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filter(pages, rule_table(spark, rules)), "page_id")
    assert got == [(i, *brute(u, sorted(set(rules)))) for i, u in enumerate(urls)]
