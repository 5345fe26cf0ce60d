from conftest import FOLDER
from oracle import compare, connect

from stylegraph.llm.queries import QUERIES, SQL
from stylegraph.llm.url_filters import DAMPING, ROUNDS, RULES, judge_urls, propagate

SCHEMA = "page_id bigint, url string, html string, host string, rule string, kind string, pages bigint"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1) for r in rows], SCHEMA)


def rule_of(url):
    """Host, path, rule and its verdict by plain string work."""
    rest = (url or "").partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(r), r, v) for v, r in RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h))
            and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://x.www.example.com/en/z#t",
        "http://notexample.com/en/", "http://example.com?x/en/", "http://b.net/es/1", "http://b.net/es", "http://net/fr/",
        "http://internet/fr/", "//x.com/", None, "", "ftp://com/", "http://com", "http://ÄÖ.COM/ä", "http://:80/", "a://b://c.com/d"]


def test_rules(spark):
    rows = [(i, u, None if i % 2 else "<p>") for i, u in enumerate(URLS)] + [(None, URLS[0], ""), (None, URLS[0], "")]
    got = judge_urls(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        host, path, rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert judge_urls(frame(spark, [])).count() == 0


def linked():
    """good.com is trusted and links to friend.org; spam.org links to what the rules block."""
    blocked = [(i, f"http://bad.net/es/{i}", "") for i in range(4)]
    to = lambda *hosts: "".join(f'<a  HREF = "https://{h}/p?x">y</a>' for h in hosts)
    return blocked + [
        (10, "http://good.com/1", to("friend.org", "friend.org", "good.com")), (11, "http://friend.org/1", ""),
        (12, "http://spam.org/1", "<a href='//bad.net/es/2'>" + to("BAD.net", "more.org")), (13, "http://more.org/", to("spam.org")),
        (14, "http://alone.org/", "<a href=/relative>http://bad.net/es/</a>"), (15, "http://bad.net/de/", "")]


def scores(pages):
    """Propagation with dictionaries."""
    import re
    hosts = {i: rule_of(u)[0] for i, u, _ in pages}
    links = {}
    for i, _, html in pages:
        for h in {h.lower() for h in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html)}:
            if h != hosts[i]:
                links[hosts[i], h] = links.get((hosts[i], h), 0) + 1
    out = []
    for verdict, edges in (("allow", links), ("block", {(b, a): n for (a, b), n in links.items()})):
        share = {}
        for i, u, _ in pages:
            share.setdefault(hosts[i], []).append(rule_of(u)[3] == verdict)
        seed = {h: (1 - DAMPING) * sum(v) / len(v) for h, v in share.items()}
        now = dict(seed)
        for _ in range(ROUNDS):
            new = dict(seed)
            for (a, b), n in edges.items():
                total = sum(m for (x, _), m in edges.items() if x == a)
                new[b] = new.get(b, 0) + DAMPING * n / total * now.get(a, 0)
            now = new
        out.append(now)
    return out


def test_propagation(spark):
    got = {r.page_id: r for r in judge_urls(frame(spark, linked())).collect()}
    trust, distrust = scores(linked())
    for r in got.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-8 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-8
    assert [got[i].verdict for i in (10, 11, 12, 14, 15)] == ["allow", "allow", "block", "allow", "block"]


def test_no_edges(spark):
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    edges = spark.createDataFrame([], "kind string, source string, target string, weight double")
    assert [tuple(r) for r in propagate(seeds, edges).collect()] == [("trust", "a", 1 - DAMPING)]


def test_query(spark):
    assert compare(QUERIES["op10_link_graph_filter"](spark, FOLDER), connect(FOLDER), SQL["op10_link_graph_filter"]) is None


def test_sql_of_links(spark):
    import duckdb
    import pandas as pd
    con = duckdb.connect()
    pages = pd.DataFrame(linked(), columns=["page_id", "url", "html"])
    con.register("pages", pages)
    df = judge_urls(frame(spark, linked())).select("page_id", "host", "path", "rule", "verdict")
    assert compare(df, con, SQL["op10_link_graph_filter"]) is None
