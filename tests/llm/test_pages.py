import re

import numpy as np
import pytest
from boundwise.llm import link_trust
from boundwise.llm.common import save, table

SCHEMA = "page_id long, url string, html string, host string, blocked int, mass int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return (lower(m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [r for r in link_trust.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com/en/7", "http://example.com/en/8", "https://notexample.com/en/7", "x://a.EXAMPLE.net/de/80?q#f", "x://net/de/", "x://example.net?/de/", "x://é.ORG/es/ü#", "a://b://c.org/es/", "http://sub.example.com/en/71/x", "http://org", "http://internet/de/", "http://ÄB.com/en/"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(3, "http://", None)]
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in link_trust.judged(frame(spark, rows)).select("page_id", "host", "path", "rule").collect())
    want = []
    for i, u, _ in rows:
        host, path = parts(u)
        r = rule_of(host, path)
        want.append((i, host, path, r and r.host + r.path))
    assert [g[:3] for g in got] == sorted(w[:3] for w in want)
    assert {g[0]: g[3] for g in got} == {w[0]: w[3] for w in want}


def test_nothing(spark):
    assert link_trust.judged(frame(spark, [])).collect() == []


def brute(rows, follow=link_trust.FOLLOW):
    """Trust and distrust of each host with pages, by dense power iteration."""
    seen, edges = {}, {}
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            n, good, bad = seen.get(host, (0, 0, 0))
            rule = rule_of(host, path)
            seen[host] = n + 1, good + bool(rule and rule.verdict == "allow"), bad + bool(rule and rule.verdict == "block")
            for dst in re.findall(r'href="https?://([^/"?#]+)', html or ""):
                if dst != host:
                    edges[host, dst] = edges.get((host, dst), 0) + 1
    names = sorted({*seen, *(x for e in edges for x in e)})
    at = {h: i for i, h in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for (s, d), n in edges.items():
        a[at[s], at[d]] = n

    def rank(m, seeds):
        """The solution itself: mass at hosts without links returns to the seeds."""
        if not seeds.sum():
            return seeds, 1.0
        m = np.where(m.sum(axis=1, keepdims=True) > 0, m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300), seeds / seeds.sum())
        x = np.linalg.solve((np.eye(len(m)) - follow * m).T, (1 - follow) * seeds)
        assert x.sum() == pytest.approx(seeds.sum())
        free = np.linalg.solve((np.eye(len(m)) - follow * np.where(a_of(m, seeds), m, 0)).T, (1 - follow) * seeds)
        return x, (1 - follow) * seeds.sum() / free.sum()

    def a_of(m, seeds):
        return ~np.isclose(m, seeds / seeds.sum()).all(axis=1, keepdims=True)

    seeds = [np.array([seen.get(h, (0, 0, 0))[k] for h in names], float) for k in (1, 2)]
    (trust, _), (distrust, own) = rank(a, seeds[0]), rank(a.T, seeds[1])
    return {h: (seen[h][0], trust[at[h]], distrust[at[h]]) for h in seen}, own


def test_propagation_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    hosts = [f"h{i}.example.{('com', 'net', 'org', 'edu')[i % 4]}" for i in range(16)]
    rows = []
    for p in range(150):
        h = hosts[int(rng.integers(0, 16)) if p % 3 else 0]  # one host has a third of all pages
        targets = rng.choice(16, int(rng.integers(0, 4)))
        html = "".join(f'<a href="http://{hosts[t]}/x">y</a>' for t in targets) + '<a href="/own">z</a>'
        rows.append((p, f"http://{h}/{('en', 'de', 'es')[int(rng.integers(0, 3))]}/{int(rng.integers(1, 99))}", html if p % 7 else None))
    pages, (want, own) = frame(spark, rows), brute(rows)
    ranked = save(link_trust.hosts(pages), "ranked")
    got = {r.host: r for r in ranked.collect()}
    assert got.keys() == want.keys()
    for h, (n, trust, distrust) in want.items():
        assert got[h].n_pages == n
        assert got[h].trust == pytest.approx(trust, abs=1e-3) and got[h].distrust == pytest.approx(distrust, abs=1e-3)
    blocked = {h for h, (n, t, d) in want.items() if d > t and d > link_trust.DENSITY * own * n}
    monkeypatch.setattr(link_trust, "hosts", lambda *_, **__: ranked)
    verdicts = {r.page_id: r.verdict for r in link_trust.judged(pages).collect()}
    for p, url, _ in rows:
        host, path = parts(url)
        rule = rule_of(host, path)
        assert verdicts[p] == (rule.verdict if rule else "block" if host in blocked else "allow")


def test_trust_reaches_the_end_of_a_long_chain(spark):
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(34)], "src string, dst string, n long")
    got = {r.host: r.mass for r in link_trust.propagated(seeds, edges).collect()}
    all_ = (1 - 0.85**35) / 0.15
    assert got == {f"h{i}": pytest.approx(0.85**i / all_, rel=1e-9) for i in range(35)}


def test_a_cycle_keeps_all_mass(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 3)], "src string, dst string, n long")
    got = {r.host: r.mass for r in link_trust.propagated(seeds, edges).collect()}
    assert got == {"a": pytest.approx(1 / 1.85, abs=1e-5), "b": pytest.approx(0.85 / 1.85, abs=1e-5)}


def test_rounds_bring_the_change_below_its_limit():
    for follow in (0.5, 0.85, 0.95):
        k = link_trust.rounds_to(1e-6, follow)
        assert (1 - follow) * follow**k < 1e-6 <= (1 - follow) * follow ** (k - 1)


def test_every_page_of_the_table_is_judged(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in link_trust.judged(pages).collect()}
    rows = pages.select("page_id", "url").collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = parts(r.url)
        rule = rule_of(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule and rule.host + rule.path)
        assert g.verdict == rule.verdict if rule else g.verdict in ("allow", "block")
