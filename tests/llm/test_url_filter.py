"""Rules by longest match, verdicts by flow along links, against plain Python."""

import pytest

from ravelin.llm import url_filter

RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("bad.org", "block"), ("bad.org", "allow"), (None, "allow"),
]
URLS = [
    "http://WWW.Example.com/en/1", "https://m.example.com/en/x?y", "https://example.com", "http://a.net/es/", None,
    "no scheme", "ftp://x.com/?a://b/c", "http://notexample.com/en/", "http://sub.bad.org/q#f", "http://bad.org", "",
    "http://example.com/en", "x://a://b/c", "http://É.com/Ü#", "http://example.com/en/\n?",
]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule(host, path):
    fits = []
    for text, _ in RULES:
        if text is not None:
            suffix, slash, rest = text.partition("/")
            if (host == suffix or host.endswith("." + suffix)) and path.startswith(slash + rest):
                fits.append(text)
    return max(fits, key=len, default=None)


def test_rules(spark):
    verdicts = dict(sorted((r for r in RULES if r[0]), key=lambda r: r[1]))  # block over allow
    pages = spark.createDataFrame(list(enumerate(URLS)) * 2, "page_id long, url string")
    pages = pages.selectExpr("*", "CAST(NULL AS string) AS html", "1 AS host", "2 AS rule")
    out = url_filter.judged(pages, spark.createDataFrame(RULES, "rule string, verdict string"), "page_id", "url", "html")
    rows = out.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = cut(URLS[r["page_id"]])
        found = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, found)
        assert r["verdict"] == (verdicts[found] if found else "allow")
    assert url_filter.judged(pages.limit(0), spark.createDataFrame(RULES, "rule string, verdict string"),
                             "page_id", "url", "html").count() == 0


def test_trust_and_distrust_flow_along_links(spark):
    def link(*hosts):
        return "".join(f'<a HREF = "https://{h}/x?y">' for h in hosts)

    graph = {"good.com": ["near.org"], "near.org": ["far.org"], "far.org": [], "bad.com": ["victim.org"],
             "spam.org": ["bad.com"], "victim.org": [], "alone.org": []}
    rows = [(i, f"http://{h}/", link(*t)) for i, (h, t) in enumerate(graph.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("good.com/", "allow"), ("bad.com/", "block")], "rule string, verdict string")
    out = {r["host"]: r for r in url_filter.judged(pages, rules, "page_id", "url", "html").collect()}
    assert {h for h, r in out.items() if r["verdict"] == "block"} == {"bad.com", "spam.org"}

    def rank(edges, seed):
        score = {h: float(h == seed) for h in graph}
        for _ in range(200):
            got = {h: 0.0 for h in graph}
            for a, targets in edges.items():
                for b in targets:
                    got[b] += 0.85 * score[a] / len(targets)
            rest = 1 - sum(got.values())
            score = {h: got[h] + rest * (h == seed) for h in graph}
        return score

    back = {h: [a for a, t in graph.items() if h in t] for h in graph}
    trust, distrust = rank(graph, "good.com"), rank(back, "bad.com")
    for h, r in out.items():
        assert abs(r["trust"] - trust[h]) < 1e-4 and abs(r["distrust"] - distrust[h]) < 1e-4


def test_scores_flow_until_they_settle(spark):
    hosts = [f"h{i}" for i in range(34)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in zip(hosts, hosts[1:])], "src string, dst string, share double")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, mass double")
    out = {r["host"]: r["score"] for r in url_filter.propagated(seeds, edges).collect()}
    start = (1 - 0.85) / (1 - 0.85 ** len(hosts))  # the chain's end returns all to the seed
    for i, h in enumerate(hosts):
        assert abs(out.get(h, 0.0) - start * 0.85**i) < 1e-4, h
    assert out["h33"] > 0
    with pytest.raises(RuntimeError, match="settle"):
        url_filter.propagated(seeds, edges, rounds=3)
