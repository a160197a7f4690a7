import re
from collections import Counter, defaultdict

from sievestone.llm.url_filters import RULES, filter_urls, op5_link_graph

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, h string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_for(host, path):
    fits = []
    for what, text in RULES:
        name, slash, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(text), text, what))
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    judged = [(i, *parts(u), *rule_for(*parts(u)), h or "") for i, u, h in rows]
    links, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for _, host, _, _, what, html in judged:
        if what:
            seeds[what][host] += 1
        for href in re.findall(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]*)", html):
            to = parts(href)[0]
            if host and to and host != to:
                links[host, to] += 1
    score = {}
    for what, flip in (("allow", False), ("block", True)):
        edges = {((b, a) if flip else (a, b)): n for (a, b), n in links.items()}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        start = {h: 0.15 * n / sum(seeds[what].values()) for h, n in seeds[what].items()}
        rank = dict(start)
        for _ in range(10):
            new = defaultdict(float, start)
            for (a, b), n in edges.items():
                new[b] += 0.85 * rank.get(a, 0.0) * n / out[a]
            rank = new
        score[what] = rank
    bad = lambda h: round(score["block"].get(h, 0.0), 12) > round(score["allow"].get(h, 0.0), 12)
    return {(i, host, path, rule, what or ("block" if bad(host) else "allow")) for i, host, path, rule, what, _ in judged}


def test_trust_and_distrust_follow_links(spark):
    a = lambda *to: "".join(f"<p><A class='x' HREF = \"{t}\">t</a>" for t in to)
    rows = [
        (1, "http://good.org/x", a("https://friend.net/1", "http://friend.net/2", "http://both.net/")), (2, "https://friend.net/a", a("http://other.net/", "/own", "mailto:x")),
        (3, "http://Bad.EXAMPLE.org/es/1", a("http://friend.net/")), (4, "http://spam.net/", a("http://bad.example.org/es/2", "http://bad.example.org/es/2")), (5, "http://feeder.net/?u=http://x.org/", a("http://spam.net/")),
        (6, "http://x.com/de/", a("http://good.org/")), (7, "http://x.com/fr/", ""), (8, "http://both.net/", a("http://bad.example.org/es/3")), (9, "http://example.org/en/15#f", None), (10, "http://example.org/en/2", ""),
        (11, None, a("http://spam.net/")), (12, "no scheme", "<a>"), (13, "http://quiet.net", ""), (14, "http://org", ""), (15, "x://u.org/?a", ""), (16, "http://notorg/", ""), (5, "http://feeder.net/?u=http://x.org/", a("http://spam.net/")),
    ]
    df = spark.createDataFrame([(i, u, h, "", "", "", "") for i, u, h in rows], SCHEMA).repartition(4)
    got = {tuple(r) for r in filter_urls(df).collect()}
    assert got == brute(rows)
    verdict = {r[0]: r[4] for r in got}
    assert (verdict[2], verdict[4], verdict[5], verdict[13]) == ("allow", "block", "block", "allow")


def test_query_and_empty(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert {tuple(r) for r in op5_link_graph(spark, "/root/testdata/sf0.001").collect()} == brute(rows)
    assert filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
