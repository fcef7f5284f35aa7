import duckdb
import pytest

from spotlake.llm import queries, url_filter
from spotlake.llm.queries_sql import URLS_SQL

URLS = [
    ("http://Sub.Example.ORG/es/1?x", "<a href='http://bad.net/'>"), ("https://example.org/en/12", ""), ("https://example.org/en/2#t", None),
    ("ftp://x.com/fr/a", '<a HREF="//good.net/p">'), ("x.com/de/", ""), (None, "<a href=http://a.net>"), ("http://", ""), ("://org", ""), ("http://org/", ""),
    ("http://notexample.org/es/", ""), ("http://a.com/de/?q", '<img src="https://spam.net/x"><a href="http://good.net">'), ("http://a.com?x=/de/", ""),
    ("http://good.net/", ""), ("http://good.net/", '<a href="http://far.net:80/">'), ("http://far.net:80/", ""), ("http://bad.net", '<a href="http://sub.example.org/es/">'),
    ("http://spam.net/a://b.org/c", '<a href="http://a.com/de/x">'), ("http://user@h.org#a/b", ""), ("http://h.org/a b\n?c", ""), ("", ""), ("http://good.net/", ""),
]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "extra") for i, (u, h) in enumerate(URLS)], "page_id BIGINT, url STRING, html STRING, verdict STRING")


def ranks(links, seeds, rounds=200, damping=0.85):
    total = sum(seeds.values())
    seeds = {h: m / total for h, m in seeds.items()}
    score = dict(seeds)
    for _ in range(rounds):
        got = {}
        for h, s in score.items():
            out = {d: n for (a, d), n in links.items() if a == h}
            for d, n in out.items():
                got[d] = got.get(d, 0) + s * n / sum(out.values())
        lost = 1 - damping * sum(got.values())
        score = {h: seeds.get(h, 0) * lost + damping * got.get(h, 0) for h in {*seeds, *got}}
    return score


def test_judged_urls(spark, pages, tmp_path):
    out = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(out) == len(URLS)
    links = {}
    trust, distrust = {}, {}
    for i, (url, html) in enumerate(URLS):
        host, path = brute(url)
        rule, verdict = rule_of(host, path)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        if verdict:
            assert out[i].verdict == verdict
            side = trust if verdict == "allow" else distrust
            side[host] = side.get(host, 0) + 1
    for r in url_filter.host_links(pages).collect():
        links[r.src, r.dst] = r.n
    assert links == {("sub.example.org", "bad.net"): 1, ("x.com", "good.net"): 1, ("a.com", "spam.net"): 1, ("a.com", "good.net"): 1,
                     ("good.net", "far.net:80"): 1, ("bad.net", "sub.example.org"): 1, ("spam.net", "a.com"): 1}
    t, d = ranks(links, trust), ranks({(b, a): n for (a, b), n in links.items()}, distrust)
    for i, (url, _) in enumerate(URLS):
        host, path = brute(url)
        if rule_of(host, path)[1] is None:
            blocked = d.get(host, 0) > 0.5 * (t.get(host, 0) + d.get(host, 0)) and d.get(host, 0) > 0
            assert out[i].verdict == ("block" if blocked else "allow"), url
    assert {"allow", "block"} == {out[i].verdict for i, (u, _) in enumerate(URLS) if rule_of(*brute(u))[1] is None}
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({URLS_SQL})").fetchall()
    assert sorted(want) == sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op2_url_filters(spark, str(tmp_path)).collect())


def test_empty_table(pages):
    assert url_filter.judge_urls(pages.where("false")).collect() == []


@pytest.mark.parametrize("ring", [False, True])
def test_long_paths_and_cycles(spark, ring, tmp_path):
    """Sixty hosts in a row (scores), or in a circle with two ways (verdicts, SQL too), behind an allowed and a blocked page."""
    rows = [(0, "http://x.com/fr/", '<a href="http://h0.net">'), (1, "http://y.com/de/", ""), (2, "http://h59.net/", '<a href="http://y.com/"><a href="http://h0.net">' if ring else '<a href="http://y.com/">')]
    rows += [(10 + i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net">' + (f'<a href="http://h{i - 1}.net">' if ring and i else "")) for i in range(59)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    links = {(r.src, r.dst): r.n for r in url_filter.host_links(pages).collect()}
    t, d = ranks(links, {"x.com": 1}, 400), ranks({(b, a): n for (a, b), n in links.items()}, {"y.com": 1}, 400)
    if not ring:
        seeds = spark.createDataFrame([("x.com", "trust", 1.0), ("y.com", "distrust", 1.0)], "host STRING, kind STRING, mass DOUBLE")
        scores = {(r.host, r.kind): r.score for r in url_filter.propagate(url_filter.host_links(pages), seeds).collect()}
        for kind, want in (("trust", t), ("distrust", d)):
            assert all(abs(scores.get((h, kind), 0) - v) < 1e-8 for h, v in want.items())
        return
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()}
    for i in range(60):
        host = f"h{i}.net"
        assert got[10 + i if i < 59 else 2] == ("block" if d.get(host, 0) > t.get(host, 0) else "allow"), host
    assert {"allow", "block"} == {got[10 + i] for i in range(59)}
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(con.execute(f"SELECT page_id, verdict FROM ({URLS_SQL})").fetchall()) == got
