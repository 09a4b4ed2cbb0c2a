import random
import re

import numpy as np
import pytest

from nearfold.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "net/", "http://net", "http://NET/", "http://a.example.net/en/x?y#z", "https://a.example.net/EN/", "x://badexample.net/en/", "http://ÉA.Example.com/de/\n/x", "http://example.com/de", "http://example.com?/de/", "a://b://c.org/fr/", "http://org/fr/?q", "http:///fr/", "http://org#/fr/", "ftp://q.org/fr", "http://x.com\n.net/a"]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    out = {r["page_id"]: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    for i, u, _ in rows:
        host, path = split(u)
        verdict, rule = rule_of(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), u
        same = [rule_of(*split(x))[0] for x in URLS if host and split(x)[0] == host]
        by_host = "block" if same and (same.count("block") - same.count("allow")) / len(same) >= 0.5 else "allow"
        assert out[i]["verdict"] == (verdict or by_host), u


def solved(hosts, shares, good, bad, damping=0.85):
    """trust and distrust of every host by linear equations."""
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in shares.items():
        m[at[a], at[b]] += w
    g, c = (np.array([float(x.get(h, 0)) for h in hosts]) for x in (good, bad))
    eye = np.eye(len(hosts))
    stop = np.where(m.sum(axis=1) > 0, 1 - damping, 1.0)
    rank = lambda seed: np.linalg.solve(eye - damping * m.T, (1 - damping) * seed)
    trust, distrust = rank(g) / rank(np.ones(len(hosts))), np.linalg.solve(eye - damping * m, stop * c)
    return {h: (trust[i], distrust[i]) for h, i in at.items()}


#: A small graph, a long chain and two cycles.
SHARES = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 1.0, ("c", "d"): 1.0, ("d", "e"): 0.25, ("d", "a"): 0.75}
SHARES |= {(f"c{i:02}", f"c{i + 1:02}"): 1.0 for i in range(30)} | {("p", "q"): 1.0, ("q", "p"): 1.0, ("r", "s"): 1.0, ("s", "r"): 1.0}
GOOD, BAD = {"a": 1.0, "c00": 1.0, "r": 1.0}, {"e": 1.0, "b": 0.5, "c30": 1.0, "p": 0.17, "s": 0.9}


def test_propagation_equals_the_linear_equations(spark):
    shares, good, bad = SHARES, GOOD, BAD
    hosts = sorted({x for e in shares for x in e})
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in hosts], "host string, good double, bad double")
    links = spark.createDataFrame([(a, b, w) for (a, b), w in shares.items()], "src string, dst string, share double")
    want = solved(hosts, shares, good, bad)
    for r in urls.propagate(seeds, links).collect():
        assert (r["trust"], r["distrust"]) == pytest.approx(want[r["host"]], abs=1e-3)
        assert 0 <= r["trust"] <= 1 and 0 <= r["distrust"] <= 1
        assert (r["distrust"] - r["trust"] >= 0.5) == (want[r["host"]][1] - want[r["host"]][0] >= 0.5)


def test_verdicts_equal_brute_force_end_to_end(spark):
    rng = random.Random(6)
    names = [f"h{i}.{['net', 'com', 'com', 'org', 'net', 'com'][i % 6]}" for i in range(14)]
    rows = []
    for i in range(60):
        body = "".join(f"<a {rng.choice(['', 'class=x ', 'data-a=\'1 > 0\' '])}href='{rng.choice(['http:', 'https:', ''])}//{rng.choice(names)}/{rng.choice('xy')}'>t</a>" for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{rng.choice(names)}/{rng.choice(['en/', 'fr/', 'de/', ''])}p{i}", body or None))
    rows += [(60, "http://farm.com/p", "<a href='//dead.net/x'>t</a>"), (61, "http://dead.net/x", None)]
    edges, pages = {}, {}
    for _, url, body in rows:
        host, path = split(url)
        pages.setdefault(host, []).append(rule_of(host, path)[0])
        for to in re.findall(r"href='(?:https?:)?//([^/]*)", body or ""):
            if to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = sorted(set(pages) | {x for e in edges for x in e})
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    share = lambda kind: {h: v.count(kind) / len(v) for h, v in pages.items()}
    want = solved(hosts, {e: n / out[e[0]] for e, n in edges.items()}, share("allow"), share("block"))
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    seen = set()
    for i, url, _ in rows:
        host, path = split(url)
        trust, distrust = want[host]
        if abs(distrust - trust - 0.5) > 2e-3:
            verdict = rule_of(host, path)[0] or ("block" if distrust - trust >= 0.5 else "allow")
            assert got[i] == verdict
            seen.add((rule_of(host, path)[0], verdict))
    assert {(None, "allow"), (None, "block")} <= seen


def test_links_of_any_length(spark):
    html = [
        '<a href="//x.net/">',
        '<A data-x="' + "y" * 9000 + '" HREF="http://x.net/">',
        "<a title='1 > 0' \n href   =" + " " * 40 + "'https://x.net/a'>",
        "<a " + "k " * 5000 + "href=//x.net>",
        '<a data-href="//y.com" href="//x.net/q">',
        "<abbr href='//y.com'><a>//y.com</a><a name=b>",
    ]
    frame = spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(html)], "src string, html string")
    assert sorted((r["src"], r["dst"]) for r in urls.link_shares(frame, "src", "html").collect()) == [(f"h{i}", "x.net") for i in range(5)]


def test_linkers_to_blocked_hosts_fall_and_trusted_ones_stand(spark):
    to = lambda *xs: "".join(f'<p><A class="x"\n HREF={q}{x}{q}>t</a>' for x in xs for q in ('"',))
    rows = [
        (1, "http://bad.net/x", None),
        (2, "http://farm.com/a", to("http://bad.net/1", "//bad.net/2", "/own", "http://farm.com/b")),
        (3, "http://farm.com/b", "no links"),
        (4, "http://mixed.com/a", to("http://bad.net/1", "https://fine.com/", "https://fine2.com/")),
        (5, "http://good.org/fr/1", to("https://friend.com/")),
        (6, "http://friend.com/z", to("http://bad.net/q")),
        (7, "http://second.com/", to("http://farm.com/")),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, Verdict string")
    out = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, RULES).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_broadcast_limit_changes_nothing(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5}.com/", '<a href="http://x.net/">') for i in range(20)] + [(99, "http://x.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = sorted(urls.url_filter(pages, RULES).collect())
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 0)
    assert sorted(urls.url_filter(pages, RULES).collect()) == small and {r["verdict"] for r in small} == {"block"}
    assert urls.url_filter(pages.limit(0), RULES).count() == 0


def test_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert not any(x in urls.url_filter(pages, RULES)._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


def test_propagation_runs_until_nothing_moves(spark):
    hosts = [f"c{i:02}" for i in range(15)]
    seeds = spark.createDataFrame([(h, 0.0, float(h == hosts[-1])) for h in hosts], "host string, good double, bad double")
    links = spark.createDataFrame([(a, b, 1.0) for a, b in zip(hosts, hosts[1:])], "src string, dst string, share double")
    got = {r["host"]: r["distrust"] for r in urls.propagate(seeds, links, tolerance=1e-3).collect()}
    assert all(got[h] == pytest.approx(0.85 ** (14 - i)) for i, h in enumerate(hosts))
    with pytest.raises(RuntimeError):  # shares of more than all
        urls.propagate(seeds, links.withColumn("share", links["share"] * 4), 0.5, tolerance=0.2)
