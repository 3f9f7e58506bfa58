from itertools import product

from fathomline.llm import url_rules
from fathomline.llm.queries import URL_RULES

RULES = [*URL_RULES, ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("org", "/x/y/z", "block"), ("b.a.org", "", "block"), ("org", "/x", "block"), ("org", "/x", "allow")]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [((h.count("."), len(h), len(p), v), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_both_ways_agree_with_brute_force(spark):
    hosts = ["org", "a.org", "b.a.org", "ba.org", "c.b.a.org", "EXAMPLE.org", "m.example.org", "example.com", "x.com", "net", "", "a..org", "org."]
    tails = ["", "/", "/x", "/x/y", "/x/y/z", "/es/1?q=/x", "/en/12#/es/", "/fr/", "?x://y/", "#a"]
    urls = [f"http://{h}{t}" for h, t in product(hosts, tails)] + [None, "", "no scheme", "://org/x", "http://org/x"] * 2
    df = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(5)
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string")
    want = {i: by_hand(u) for i, u in enumerate(urls)}
    for most in (1000, 2):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, rules, most_rules=most).collect()}
        assert got == want
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(df, rules.limit(0)).collect()} == {"allow"}
