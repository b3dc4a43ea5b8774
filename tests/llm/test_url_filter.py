import random

from ranksmith.llm.url_filter import RULES, Rule, filter_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, default
    r = max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "allow"))
    return host, path, r.host + r.path, r.verdict


def urls():
    rng = random.Random(2)
    out = [None, "", "no scheme", "http://", "://COM/en/x", "https://com/en/", "x://example.com/en/7", "x://a.example.com/en/77?q", "x://notexample.com/en/7", "x://b.Example.NET/de/8#f", "x://net/de/9", "x://net", "x://org/es/", "x://o.org/es", "x://a://b/en/", "x://example.com:80/en/7", "x://é.com/en/ü", "x://.com/en/1", "x://com./en/1", "x://a..com/en/"]
    for _ in range(300):
        host = ".".join(rng.choices(["a", "b", "example", "www", "é"], k=rng.randint(0, 3)) + [rng.choice(["com", "net", "org", "example"])])
        out.append(f"http://{host}{rng.choice(['', '/', '/en/', '/en/7', '/en/71', '/de/8x', '/es/a/b'])}{rng.choice(['', '?a=/en/7', '#x'])}")
    return out * 2


def check(spark, rules):
    rows = [(i if i % 7 else None, u, "h") for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = sorted((tuple(r) for r in filter_urls(pages, rules=rules).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u, _ in rows), key=str)


def test_rules_of_the_query(spark):
    check(spark, RULES)


def test_deep_rules(spark):
    rules = [Rule("block", "com", "/"), Rule("allow", "example.com", "/"), Rule("block", "example.com", "/en/7"), Rule("allow", "a.example.com", "/en/"), Rule("block", "com", "/en/71"), Rule("block", "www.a.com", "")]
    check(spark, rules + [Rule("allow", "net", "/d"), Rule("block", "b.net", "/de/"), Rule("allow", "b.net", "/de/8x")])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages).count() == 0
    assert filter_urls(spark.createDataFrame([(1, "x://a.com/")], "page_id long, url string"), rules=()).first().verdict == "allow"
