import random

from polyspark.llm import url_filters as u


def brute(url, rules, default="allow"):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        rest = ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def test_against_brute_force(spark):
    rng = random.Random(2)
    labels = ["a", "b", "example", "org", "com", "ORG", "", "xn--p"]
    urls = [None, "", "no scheme", "://", "http://", "https://EXAMPLE.org", "http://a.com/fr/x?y#z", "http://org?q", "x://a://b/c", "http://a.org/\nnew/line"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}/{rng.choice(['es/', 'en/1', 'en/12', 'fr/', 'de/', ''])}{rng.randint(0, 9)}" for _ in range(500)]
    urls += ["http://hot.example.org/en/1"] * 300
    pages = spark.createDataFrame([(i if i % 50 else None, x, "z") for i, x in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    rules = [*u.RULES, u.Rule("b.org", "/", "block"), u.Rule("b.org", "/", "allow"), u.Rule("a.b.org", "/en/", "allow"), u.Rule("org", "/en/1", "block")]
    rows = pages.collect()
    for used in (rules, u.RULES, []):
        got = u.judge(pages, spark.createDataFrame([(r.host, r.path, r.verdict) for r in used], "host string, path string, verdict string")).collect()
        want = sorted(map(repr, ((r.page_id, *brute(r.url, used)) for r in rows)))
        assert sorted(map(repr, map(tuple, got))) == want


def test_empty_table(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
