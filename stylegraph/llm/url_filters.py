"""URL filters: host and path rules, and link-graph propagation where no rule fits.

Hosts whose pages the rules allow are trusted, hosts whose pages they block are not.
Trust flows along links (personalised PageRank from the trusted hosts), distrust
against them (a host that links to blocked ones), and the difference is thresholded per host. DataFrame and
SQL functions only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.llm.common import only
from stylegraph.operators.skew import lookup_join
from stylegraph.sources.staging import settle

#: (verdict, rule): the rule's host covers its subdomains, the rule's path is a prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Links that name a host: absolute or protocol-relative values of href and src.
LINK = r"""(?i)\b(?:href|src)\s*+=\s*+["']?\s*+(?:https?:)?//([^/?#"'\s<>]++)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5


def lowered(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://`` or without a url."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return lowered(F.regexp_extract(rest, r"^([^/?#]*+)", 1)), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rule_host, rule_path, rule, rule_verdict``; any table of this form will do."""
    kind = "array<struct<rule_host:string,rule_path:string,rule:string,rule_verdict:string>>"
    rows = F.array(*[F.struct(*map(F.lit, (lowered_text(r.partition("/")[0]), "/" + r.partition("/")[2], r, v)))
                     for v, r in rules]).cast(kind)
    return spark.range(1).select(F.inline(rows))


def lowered_text(host: str) -> str:
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rules``: those of each host and of the domains above it, longest first."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    fitting = above.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        (-F.length("rule")).alias("size"), "rule", "rule_path", "rule_verdict"))).alias("rules"))
    return hosts.join(fitting, "host", "left")


def edges_of(links: DataFrame) -> DataFrame:
    """``(kind, source, target, weight)``: trust along ``links(host, to, n)``, distrust against them.

    The weights out of a source add up to 1.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("host").alias("source"), F.col("to").alias("target"), "n"
                        ).unionByName(links.select(F.lit("distrust").alias("kind"), F.col("to").alias("source"),
                                                   F.col("host").alias("target"), "n"))
    totals = both.groupBy("kind", "source").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_n"))
    return lookup_join(both, totals, ["kind", "source"], counted="_n").select(
        "kind", "source", "target", (F.col("n") / F.col("_all")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``kind, host, score`` by personalised PageRank from ``seeds(kind, host, seed)``.

    ``rounds`` steps of ``score = (1 - damping) * seed + damping * sum(weight * score of the source)``.
    """
    start = settle(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score")), "seeds")
    edges = settle(edges, "edges")
    scores = start
    if edges.isEmpty():
        return scores
    for _ in range(rounds):
        sent = lookup_join(edges, scores.withColumnRenamed("host", "source"), ["kind", "source"]).select(
            "kind", F.col("target").alias("host"), (damping * F.col("weight") * F.col("score")).alias("score"))
        scores = settle(start.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
    return scores


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING,
               rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Verdict for each url of ``pages(page_id, url, html)``.

    Returns ``page_id, host, path, rule, verdict, trust, distrust``. The longest rule that
    fits decides; elsewhere the host is blocked when distrust exceeds trust by more
    than ``threshold`` times the score of a host all of whose pages are blocked.
    A null url or one without ``://`` has empty host and path, fits no rule and is allowed; null html
    has no links; null and repeated ids are rows like others; no rows give no rows.
    """
    slim = only(pages, page_id="bigint", url="string", html="string")
    host, path = parts(F.col("url"))
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    # hosts end before a port or after credentials as they stand: the contract's host keeps both
    slim = settle(slim.select("page_id", host.alias("host"), path.alias("path"),
                              F.array_distinct(F.transform(found, lowered)).alias("links")), "pages")
    counts = slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = host_rules(counts, rule_table(pages.sparkSession, rules))
    longest = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(1))
    ruled = settle(lookup_join(slim, hosts, ["host"], counted="pages").select(
        "page_id", "host", "path", longest.alias("_r")).select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.rule_verdict").alias("_v")), "ruled")
    shares = ruled.filter("host <> ''").groupBy("host").agg(
        F.avg(F.coalesce((F.col("_v") == "allow").cast("double"), F.lit(0.0))).alias("trust"),
        F.avg(F.coalesce((F.col("_v") == "block").cast("double"), F.lit(0.0))).alias("distrust"))
    seeds = shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)"))
    links = (slim.filter("host <> ''").select("host", F.explode("links").alias("to")).filter("host <> to")
             .groupBy("host", "to").agg(F.count(F.lit(1)).alias("n")))
    scores = propagate(seeds.filter("seed > 0"), edges_of(settle(links, "links")), damping, rounds)
    by_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    by_host = counts.join(by_host, "host", "left")
    judged = lookup_join(ruled, by_host, ["host"], counted="pages")
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust"))
    own = F.when(distrust - trust > threshold * (1 - damping), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_v", own).alias("verdict"),
                         trust.alias("trust"), distrust.alias("distrust"))


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS,
               threshold: float = THRESHOLD) -> str:
    """DuckDB text of the query's five columns."""
    values = ", ".join(f"('{lowered_text(r.partition('/')[0])}', '/{r.partition('/')[2]}', '{r}', '{v}')" for v, r in rules)
    link = LINK.replace("(?i)", "").replace("++", "+").replace("*+", "*").replace("'", "''")
    steps = "".join(f""",
s{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM s0 UNION ALL
    SELECT e.kind, e.target, {damping} * e.weight * s.score FROM e JOIN s{k - 1} s ON s.kind = e.kind AND s.host = e.source)
    GROUP BY kind, host)""" for k in range(1, rounds + 1))
    return rf"""
WITH rules(rule_host, rule_path, rule, rule_verdict) AS (VALUES {values}),
u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, html,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT p.k, max(struct_pack(size := length(rule), rule := rule, verdict := rule_verdict)) AS best FROM p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY p.k),
j AS (SELECT p.k, page_id, html, host, path, best.rule AS rule, best.verdict AS v FROM p LEFT JOIN r ON p.k = r.k),
l AS (SELECT host, t AS "to", count(*) AS n FROM (SELECT host, unnest(list_distinct(list_transform(
    regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i'),
    lambda x: translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}')))) AS t FROM j WHERE host <> '')
    WHERE host <> t GROUP BY ALL),
b AS (SELECT 'trust' AS kind, host AS source, "to" AS target, n FROM l UNION ALL SELECT 'distrust', "to", host, n FROM l),
e AS (SELECT kind, source, target, n / sum(n) OVER (PARTITION BY kind, source) AS weight FROM b),
h AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS trust,
    avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j WHERE host <> '' GROUP BY host),
s0 AS (SELECT kind, host, {1 - damping} * seed AS score FROM (
    SELECT 'trust' AS kind, host, trust AS seed FROM h UNION ALL SELECT 'distrust', host, distrust FROM h) WHERE seed > 0){steps},
f AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), 9) AS trust,
    round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), 9) AS distrust FROM s{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {threshold * (1 - damping)}
    THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN f ON f.host = j.host"""
