import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.llm.url_filter import RULES, judge_urls


def parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def rank(edges, seeds, damping=0.85):
    """PageRank as it is usually put: a surfer who stops, or finds no link, goes on at a seed."""
    out, score = defaultdict(list), dict(seeds)
    for (a, b), w in edges.items():
        out[a].append((b, w))
    for _ in range(400):
        new, back = defaultdict(float), 0.0
        for a, s in score.items():
            total = sum(w for _, w in out[a])
            for b, w in out[a]:
                new[b] += damping * s * w / total
            back += s if not out[a] else (1 - damping) * s
        for h, s in seeds.items():
            new[h] += back * s
        score = new
    return score


def links_of(html):
    for m in re.finditer(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", html or "", re.I):
        link = next(g for g in m.groups() if g is not None)
        yield "http:" + link if link.startswith("//") else link


def brute(rows, same_domain=False):
    edges, own, hosts = Counter(), {"allow": Counter(), "block": Counter()}, set()
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            hosts.add(host)
            for target in links_of(html):
                if (to := parts(target)[0]) and to != host:
                    edges[host, to] += 1
            if verdict := rule_of(host, path)[1]:
                own[verdict][host] += 1
    domains = set()
    for host in hosts if same_domain else ():
        labels = host.split(".")
        domains |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 2)}
    for low, high in domains:
        edges[low, high] += 1
        edges[high, low] += 1
    ranks = []
    for verdict, graph in (("allow", edges), ("block", {(b, a): w for (a, b), w in edges.items()})):
        n = sum(own[verdict].values()) or 1
        ranks.append(rank(graph, {h: c / n for h, c in own[verdict].items()}) if own[verdict] else {})
    out = []
    for page, url, _ in rows:
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        trust, distrust = (r.get(host, 0.0) for r in ranks)
        out.append((page, host, path, rule, verdict or ("block" if distrust > trust * (1 + 1e-9) else "allow"), pytest.approx(trust, abs=5e-4), pytest.approx(distrust, abs=5e-4)))
    return out


def check(spark, rows, same_domain=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    clashing = [F.lit("x").alias(c) for c in ("host", "path", "rule", "_id", "fit", "trust", "verdict", "src")]
    got = sorted(map(tuple, judge_urls(df.select("*", *clashing), same_domain=same_domain, tolerance=1e-4).collect()), key=lambda r: repr(r[:5]))
    want = sorted(brute(rows, same_domain), key=lambda r: repr(r[:5]))
    assert got == want
    return got


@pytest.mark.parametrize("same_domain", [False, True])
def test_against_brute_force(spark, same_domain):
    rng = random.Random(11)
    hosts = [f"{a}{b}" for a in ("", "www.", "Blog.", "a.b.") for b in ("example.com", "example.net", "shop.net", "site.org", "other.io", "alone.de", "x.y.dev")]
    rows = []
    for i in range(200):
        targets = [rng.choice([f"http://{rng.choice(hosts)}/x", f"//{rng.choice(hosts)}/y", "/relative", "#here"]) for _ in range(rng.randrange(6))]
        links = " ".join(f"<a {rng.choice(['href=', 'HREF = ', 'Href='])}{q}{t}{q}>" for t in targets for q in [rng.choice(["'", '"', ""])])
        rows.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/a', '/fr/x', '?q=://z', '#a'])}", links))
    got = check(spark, rows, same_domain)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_distrust_reaches_far_and_other_graphs_change_nothing(spark):
    """A chain of 30 hosts to a blocked one, beside it a star of many hosts with a seed of its own."""
    chain = [(i, f"http://c{i}.io/", f"href=//c{i + 1}.io/") for i in range(30)] + [(30, "http://c30.io/", "href='http://bad.net/'"), (31, "http://bad.net/", None)]
    star = [(1000 + i, f"http://s{i}.dev/", "href=http://hub.dev/") for i in range(300)] + [(2000, "http://hub.dev/", "href=http://far.net"), (2001, "http://far.net/", None)]
    alone, both = (check(spark, rows) for rows in (chain, chain + star))
    verdicts = {r[0]: r[4] for r in both}
    assert all(verdicts[r[0]] == r[4] == "block" for r in alone)


def test_odd_rows_and_empty_table(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "no scheme", None), (3, "://", "x"), (4, "http://NET", None), (5, "http://net/", None), (6, "a://b\nc/d", None), (7, "http://É.NET/en/" + "x" * 50_000, None), (8, "http://h//?#", "href='http://net/'"), (9, "http://.net/", None)]
    check(spark, rows)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_host_with_most_links(spark):
    check(spark, [(i, "http://hub.io/a", f"href='http://h{i}.net/'") for i in range(150)] + [(1000, "http://ok.org/fr/", "href='http://hub.io'"), (1001, "http://h3.net/", "href='http://hub.io'")])
