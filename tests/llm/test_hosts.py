"""Rules and host reputations against a plain computation."""

from collections import defaultdict

import pytest

from tidegauge.llm import hosts

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def rule_of(host, path):
    fits = [(t, v) for v, t in RULES
            if (host == t[:t.index("/")] or host.endswith("." + t[:t.index("/")])) and path.startswith(t[t.index("/"):])]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def plain(rows):
    """Posterior bound per host."""
    own = defaultdict(lambda: [0, 0])
    for _, url, ok in rows:
        own[split(url)[0]][0] += ok is not None
        own[split(url)[0]][1] += ok is False

    def domain(h):
        return ".".join(h.split(".")[-2:])

    def suffix(d):
        return d.split(".", 1)[1] if "." in d else ""

    def up(table, name):
        out = defaultdict(lambda: [0, 0])
        for key, (n, k) in table.items():
            out[name(key)][0] += n
            out[name(key)][1] += k
        return out

    domains = up(own, domain)
    suffixes = up(domains, suffix)
    prior = {"": (sum(k for _, k in own.values()) + 0.5) / (sum(n for n, _ in own.values()) + 1)}
    parent = lambda key: ""
    for table, nxt in ((suffixes, suffix), (domains, domain), (own, None)):
        ex = sum((k - n * prior[parent(g)]) ** 2 - n * prior[parent(g)] * (1 - prior[parent(g)]) for g, (n, k) in table.items())
        sc = sum(n * (n - 1) * prior[parent(g)] * (1 - prior[parent(g)]) for g, (n, k) in table.items())
        r = ex / sc if sc else 0
        m = min(1000, max(2, 1 / r - 1)) if r > 0 else 1000
        after = {g: ((k + m * prior[parent(g)]) / (n + m), n + m) for g, (n, k) in table.items()}
        prior, parent = {g: s for g, (s, _) in after.items()}, nxt
    return {h: max(0, s - hosts.Z * (s * (1 - s) / (size + 1)) ** 0.5) for h, (s, size) in after.items()}


def make():
    rows = []
    for i in range(400):
        host = f"{'www.' if i % 3 else ''}site{i % 11}.{'example' if i % 2 else 'other'}.{('com', 'net', 'org')[i % 3]}"
        bad = i % 11 == 4 or i % 17 == 0
        rows.append((i, f"https://{host.upper() if i % 5 == 0 else host}/{('en', 'de', 'fr')[i % 3]}/{i}?q=://x/#t", None if i % 4 == 0 else not bad))
    rows += [(500 + i, f"http://spam.example.com/p{i}", False) for i in range(60)]
    return rows + [(900, None, True), (901, "no scheme", None), (902, "://", None), (903, "a://NET", None), (904, "a://net/", None), (905, "a://x.net?x/", False),
                   (None, "http://a.example.net/en/x", None), (906, "http://aexample.net/en/", None), (907, "x://h\nq/p\nr?", None), (907, "x://h\nq/p\nr?", True),
                   (908, "http://q.org" + "/fr" * 20000, None)]


def test_equal_to_a_plain_computation(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "capture_id long, source_url string, accepted boolean, host string, n int")
    got = sorted(hosts.judge(df, RULES).collect(), key=str)
    bounds = plain(rows)
    expected = []
    for i, url, _ in rows:
        host, path = split(url)
        rule, verdict = rule_of(host, path)
        expected.append((i, host, path, rule, verdict or ("block" if bounds[host] > 0.5 else "allow")))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.refused_bound == pytest.approx(bounds[r.host], abs=1e-9) for r in got)
    assert {r.verdict for r in got if r.host == "spam.example.com"} == {"block"}
    assert {r.verdict for r in got if r.host.endswith("site3.example.com")} == {"allow"}


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/", None)], "capture_id long, source_url string, accepted boolean")
    assert [r.verdict for r in hosts.judge(df, RULES).collect()] == ["allow"]
    assert hosts.judge(df.limit(0), RULES).count() == 0
