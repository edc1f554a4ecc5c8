import random

from turnstone.llm import urlcascade as u
from turnstone.llm.catalog import BLOCKED_HOSTS, URL_RULES


def brute(url, rules=URL_RULES, blocked=BLOCKED_HOSTS):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    under = lambda h: host == h or host.endswith("." + h)
    best = max(((len(h + p), h + p, v) for v, h, p in rules if under(h) and path.startswith(p)), default=None)
    if best:
        return host, path, best[1], best[2]
    return host, path, None, "block" if any(map(under, blocked)) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "http://net/", "http://net", "https://m.ads-track.example.com/en/1",
    "https://ads-track.example.com?x=/de/", "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/1#t", "x://y://z.org/fr/", "http://..net/", "http://b.example.net/de/en/", "http://é.ÉX.ORG/fr/", "http://a.b.c.d.e.net/" + "p" * 3000, "http://casino-win.example.net", "http://spam-farm.example.org/en/",
]


def test_verdicts(spark):
    rows = [(i % 19 or None, x, "z", "h") for i, x in enumerate(URLS + URLS[:5])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    listed = spark.createDataFrame([(h,) for h in [*BLOCKED_HOSTS, None, BLOCKED_HOSTS[0]]], "host string")
    got = sorted(map(str, (tuple(r) for r in u.judge(df, URL_RULES, listed).collect())))
    assert got == sorted(str((i, *brute(x))) for i, x, *_ in rows)
    assert u.judge(df.limit(0), URL_RULES, listed).count() == 0
    assert {r.verdict for r in u.judge(df, [], listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    rnd = random.Random(4)
    keys = [f"k{rnd.random()}" for _ in range(4000)]
    listed = keys[:1500] + ["outside"]
    universe = spark.createDataFrame([(k,) for k in keys + keys[:10]], "key string")
    c = u.build(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(c.sizes) > 2
    got = {r.key: r.hit for r in universe.select("key", c.contains(universe.key).alias("hit")).collect()}
    assert got == {k: k in set(listed) for k in keys}


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = u.judge(df, URL_RULES, spark.createDataFrame([("b.net",)], "host string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Join" not in plan
