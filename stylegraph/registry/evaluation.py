"""Queries over retrieval metrics and sweep selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylegraph.functions import vectors as V
from stylegraph.operators import cluster, metrics, sweep
from stylegraph.plans import explain, space as plan
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.registry.space import (CENTROIDS, GRID, NEAR, PAIRS, SWEEP, author_labels, labels_cte, means_cte,
                                       unit_docs)
from stylegraph.sources.staging import settle


def ranked(t: Tables):
    """Every vector is a query against the mean vectors of the 50 authors."""
    docs = t.docs50
    means = docs.groupBy(F.col("author_id").alias("candidate")).agg(
        V.vector_mean(F.col("embedding")).alias("vector"))
    scores = explain.score_rows(explain.interpretable_vectors(
        unit_docs(docs), means.select(F.col("candidate").alias("id"), "vector")))
    authors = docs.select(F.col("document_id").alias("id"), F.col("label").cast("bigint").alias("label"))
    return scores.join(authors, "id").select(
        F.col("id").alias("document_id"), "score",
        (F.col("cluster_label") % 10 == F.col("label")).cast("int").alias("hit"))


RANKED = f"""{means_cte('docs50')},
    ranked AS (SELECT d.document_id, round(list_dot_product(d.embedding, m.vector), 6) + 0.0 AS score,
        m.author_id % 10 = d.label AS hit FROM docs50 d, means m),
    bins AS (SELECT document_id, score, count(*) FILTER (WHERE hit) AS pos,
        count(*) FILTER (WHERE NOT hit) AS neg FROM ranked GROUP BY 1, 2)"""


def curve(keys: str, bins: str = "bins") -> str:
    """CTEs of the cumulative counts, EER, AP and NDCG of ``bins`` per key."""
    return f"""
    cumulative AS (SELECT {keys}, score, pos, neg,
        sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
        sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n
        FROM {bins} WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
    steps AS (SELECT *, lag(tps) OVER w AS ti, lag(fps) OVER w AS fi, lead(tps) OVER w AS tn,
        lead(fps) OVER w AS fn FROM cumulative WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
    points AS (SELECT {keys}, 1 - tps / p AS fnr, fps / n AS fpr, -score AS place FROM steps
        WHERE p > 0 AND n > 0 AND (ti IS NULL OR tn IS NULL OR tps - ti <> tn - tps OR fps - fi <> fn - fps)
        UNION ALL SELECT DISTINCT {keys}, 1.0, 0.0, -1e9 FROM steps WHERE p > 0 AND n > 0),
    eers AS (SELECT k.*, coalesce(e.eer, 1.0) AS eer FROM (SELECT DISTINCT {keys} FROM {bins}) k
        LEFT JOIN (SELECT {keys}, arg_min((fnr + fpr) / 2, (round(abs(fnr - fpr), 12), place)) AS eer
        FROM points GROUP BY {keys}) e USING ({keys})),
    aps AS (SELECT {keys}, sum(CASE WHEN pos > 0 THEN pos / p * tps / (tps + fps) ELSE 0 END) AS ap
        FROM cumulative GROUP BY {keys}),
    gains AS (SELECT {keys}, p, pos / (pos + neg) * list_sum(list_transform(
        generate_series((tps + fps - pos - neg + 1)::BIGINT, (tps + fps)::BIGINT),
        lambda r: 1 / log2(r + 1))) AS gain FROM cumulative WHERE pos > 0),
    ndcgs AS (SELECT k.*, coalesce(g.ndcg, 0) AS ndcg FROM (SELECT DISTINCT {keys} FROM {bins}) k
        LEFT JOIN (SELECT {keys}, sum(gain) / any_value(list_sum(list_transform(
        generate_series(1, p::BIGINT), lambda r: 1 / log2(r + 1)))) AS ndcg
        FROM gains GROUP BY {keys}) g USING ({keys}))"""


_RANKED_SQL = with_("docs50", extra=RANKED + "," + curve("document_id"))


def _bins(t: Tables):
    return settle(metrics.score_bins(ranked(t), ["document_id"]), "bins")


@query("eer_per_query", _RANKED_SQL + "SELECT document_id, round(eer, 6) AS eer FROM eers")
def _eer(t: Tables):
    return metrics.equal_error_rate(_bins(t), ["document_id"]).select("document_id", r6("eer", "eer"))


@query("average_precision", _RANKED_SQL + "SELECT document_id, round(ap, 6) AS ap FROM aps")
def _ap(t: Tables):
    return metrics.average_precision(_bins(t), ["document_id"]).select("document_id", r6("ap", "ap"))


@query("ndcg", _RANKED_SQL + "SELECT document_id, round(ndcg, 6) AS ndcg FROM ndcgs")
def _ndcg(t: Tables):
    return metrics.ndcg(_bins(t), ["document_id"]).select("document_id", r6("ndcg", "ndcg"))


def loo_sql(keys: str, interp: str) -> str:
    """CTEs that rank all other documents for each document of ``interp(document_id, author_id, v)``."""
    same = "".join(f"a.{k.strip()} = b.{k.strip()} AND " for k in keys.split(",") if k.strip() != "document_id")
    named = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return interp + f""",
    loo AS (SELECT {named}, round(list_cosine_similarity(a.v, b.v), 12) + 0.0 AS score,
        a.author_id = b.author_id AS hit FROM interp a JOIN interp b ON {same} a.document_id <> b.document_id),
    bins AS (SELECT {keys}, score, count(*) FILTER (WHERE hit) AS pos,
        count(*) FILTER (WHERE NOT hit) AS neg FROM loo GROUP BY ALL)"""


INTERP_SQL = """interp AS (SELECT document_id, author_id, list(s ORDER BY cluster_label) AS v FROM (
        SELECT d.document_id, d.author_id, c.cluster_label, list_dot_product(d.embedding, c.centroid) AS s
        FROM quads d, centroids c) GROUP BY 1, 2)"""
_LOO_SQL = with_("quads", recursive=True, extra=",\n".join(
    [means_cte("quads"), PAIRS, labels_cte(NEAR), CENTROIDS, loo_sql("document_id", INTERP_SQL)]))


def interp_docs(t: Tables):
    """Documents in the space of the clusters of their authors, noise kept, turned into few dimensions."""
    means, labels = author_labels(t, NEAR, t.quads)
    bases = explain.directions(cluster.centroids(means, labels), normalize=False)
    narrow = explain.narrow_bases(bases.withColumn("space", F.lit(0))).drop("space")
    inner = explain.interpretable_vectors(unit_docs(t.quads), narrow)
    authors = t.quads.select(F.col("document_id").alias("id"), "author_id")
    return settle(inner.select("id", F.col("scores").alias("vector")).join(authors, "id"), "interp")


@query("leave_one_out_pairs", _LOO_SQL + "," + curve("document_id") + """
    SELECT m.*, round(e.eer, 6) AS eer, round(a.ap, 6) AS ap, round(n.ndcg, 6) AS ndcg FROM (
    SELECT document_id, sum(pos)::BIGINT AS same_author, sum(neg)::BIGINT AS other_author,
    round(sum(pos * score) / nullif(sum(pos), 0), 6) + 0.0 AS mean_same FROM bins GROUP BY document_id) m
    JOIN eers e USING (document_id) JOIN aps a USING (document_id) JOIN ndcgs n USING (document_id)""")
def _loo_pairs(t: Tables):
    ranked = metrics.leave_one_out(interp_docs(t).withColumn("space", F.lit(0)))
    return ranked.select(F.col("id").alias("document_id"), F.col("hits").alias("same_author"),
                         F.col("misses").alias("other_author"), r6("mean_hit", "mean_same"),
                         *[r6(c, c) for c in ("eer", "ap", "ndcg")])


@query("model_performance", _LOO_SQL + "," + curve("document_id") + """
    SELECT round(avg(e.eer), 3) AS eer, round(avg(a.ap), 3) AS ap, round(avg(n.ndcg), 3) AS ndcg,
    (SELECT round(avg(list_cosine_similarity(a.v, b.v)), 3) FROM interp a, interp b) AS mean_sim
    FROM eers e JOIN aps a USING (document_id) JOIN ndcgs n USING (document_id)""")
def _model_performance(t: Tables):
    return metrics.model_performance(interp_docs(t))


@query("mean_similarity", with_("docs50") + """SELECT round(avg(list_cosine_similarity(
    a.embedding, b.embedding)), 6) + 0.0 AS mean_sim FROM docs50 a, docs50 b""")
def _mean_similarity(t: Tables):
    return metrics.mean_similarity(t.docs50.select(
        F.col("embedding").alias("vector"))).select(r6("mean_sim", "mean_sim"))


@query("balanced_accuracy", """SELECT round(avg(recall), 6) AS balanced_accuracy FROM (
    SELECT quality, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS recall
    FROM labels GROUP BY quality)""")
def _balanced_accuracy(t: Tables):
    return metrics.balanced_accuracy(t.labels, "quality", "toxic").select(
        r6("balanced_accuracy", "balanced_accuracy"))


# --- sweeps: one series per event type over the hours it was seen -----------------

def series(t: Tables):
    return t.events.groupBy(
        F.col("event_type").alias("method"), F.hour("ts").cast("bigint").alias("x")).agg(
        F.round(F.avg("value"), 6).alias("m1"), F.count(F.lit(1)).cast("double").alias("m2"),
        F.round(F.max("value"), 6).alias("m3"))


SERIES = """series AS (SELECT event_type AS method, hour(ts) AS x, round(avg(value), 6) AS m1,
    count(*)::DOUBLE AS m2, round(max(value), 6) AS m3 FROM events GROUP BY 1, 2)"""


def _stable(y: str) -> str:
    return f"""(SELECT method, coalesce(min(x) FILTER (WHERE ok = 1 AND seen = 3), max(x)) AS stable_x FROM (
        SELECT method, x, min(CASE WHEN abs(step) < lim THEN 1 ELSE 0 END) OVER v AS ok,
            count(step) OVER v AS seen FROM (
            SELECT *, stddev_pop(step) OVER (PARTITION BY method) AS lim FROM (
            SELECT method, x, {y} - lag({y}) OVER (PARTITION BY method ORDER BY x) AS step FROM series))
        WINDOW v AS (PARTITION BY method ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
        GROUP BY method)"""


def _optimal(y: str, largest: bool) -> str:
    way = "DESC" if largest else "ASC"
    return f"""(SELECT b.method, CASE WHEN b.best_x = b.last_x THEN s.stable_x ELSE b.best_x END AS point FROM (
        SELECT method, first(x ORDER BY {y} {way}, x) AS best_x, max(x) AS last_x FROM series GROUP BY method) b
        JOIN {_stable(y)} s ON s.method = b.method)"""


@query("first_minimal_change", f"""WITH {SERIES} SELECT method, max(x) FILTER (WHERE calm) AS x FROM (
    SELECT method, x, abs(m1 - lag(m1) OVER w) < 40 AND abs(m2 - lag(m2) OVER w) < 40
        AND abs(m3 - lag(m3) OVER w) < 40 AS calm FROM series
    WINDOW w AS (PARTITION BY method ORDER BY x DESC)) GROUP BY method""")
def _first_minimal_change(t: Tables):
    return sweep.first_minimal_change(series(t), "x", ["m1", "m2", "m3"], 40.0, ["method"])


@query("extrema_points", f"""WITH {SERIES} SELECT method, first(x ORDER BY m1 DESC, x) AS largest,
    first(x ORDER BY m1, x) AS smallest FROM series GROUP BY method""")
def _extrema(t: Tables):
    rows = series(t)
    high = sweep.extremum(rows, "x", "m1", True, ["method"])
    low = sweep.extremum(rows, "x", "m1", False, ["method"])
    return high.select("method", F.col("best_x").alias("largest")).join(
        low.select("method", F.col("best_x").alias("smallest")), "method")


@query("stable_point", f"WITH {SERIES} SELECT method, stable_x FROM {_stable('m1')}")
def _stable_point(t: Tables):
    return sweep.stable_point(series(t), "x", "m1", ["method"])


@query("optimal_stable_point", f"WITH {SERIES} SELECT method, point FROM {_optimal('m2', True)}")
def _optimal_point(t: Tables):
    return sweep.optimal_stable_point(series(t), "x", "m2", True, ["method"])


@query("next_largest_or_equal", f"""WITH {SERIES} SELECT s.method, min(s.x) FILTER (WHERE s.x >= g.target) AS x
    FROM series s JOIN (SELECT method, avg(x) AS target FROM series GROUP BY method) g ON g.method = s.method
    GROUP BY s.method""")
def _next_largest(t: Tables):
    rows = series(t)
    targets = rows.groupBy("method").agg(F.avg("x").alias("target"))
    return sweep.next_largest_or_equal(rows, "x", targets, "target", ["method"])


@query("select_sweep_point", f"""WITH {SERIES},
    target AS (SELECT a.method, round_even((a.point + b.point + c.point) / 3, 0) AS x
        FROM {_optimal('m1', False)} a JOIN {_optimal('m2', True)} b ON b.method = a.method
        JOIN {_optimal('m3', True)} c ON c.method = a.method)
    SELECT s.method, s.x, s.m1, s.m2, s.m3 FROM series s JOIN (
        SELECT t.method, min(s.x) AS x FROM target t JOIN series s ON s.method = t.method AND s.x >= t.x
        GROUP BY t.method) k ON k.method = s.method AND k.x = s.x""")
def _select_sweep_point(t: Tables):
    return sweep.select_sweep_point(series(t), "x", {"m1": False, "m2": True, "m3": True}, ["method"])


SWEPT = """middles AS (SELECT eps, cluster_label, list(v ORDER BY pos) AS centroid FROM (
        SELECT eps, cluster_label, pos, avg(x) AS v FROM (
        SELECT s.eps, s.cluster_label, unnest(m.vector) AS x, unnest(generate_series(1, len(m.vector))) AS pos
        FROM means m JOIN sweep s ON s.author_id = m.author_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    interp AS (SELECT eps, document_id, author_id, list(s ORDER BY cluster_label) AS v FROM (
        SELECT c.eps, d.document_id, d.author_id, c.cluster_label, list_dot_product(d.embedding, c.centroid) AS s
        FROM quads d, middles c) GROUP BY 1, 2, 3)"""
_SWEPT_SQL = with_("quads", recursive=True, extra=",\n".join(
    [means_cte("quads"), PAIRS, SWEEP, loo_sql("eps, document_id", SWEPT), curve("eps, document_id"), """
    performance AS (SELECT eps, round(avg(e.eer), 3) AS eer, round(avg(a.ap), 3) AS ap, round(avg(n.ndcg), 3) AS ndcg
        FROM eers e JOIN aps a USING (eps, document_id) JOIN ndcgs n USING (eps, document_id) GROUP BY eps),
    whole AS (SELECT p.eps, p.eer, p.ap, p.ndcg, m.mean_sim, b.bases FROM performance p JOIN (
        SELECT a.eps, round(avg(list_cosine_similarity(a.v, b.v)), 3) AS mean_sim FROM interp a JOIN interp b ON a.eps = b.eps
        GROUP BY a.eps) m USING (eps) JOIN (SELECT eps, count(*) AS bases FROM middles GROUP BY eps) b USING (eps))"""]))


def performance(t: Tables):
    return plan.sweep_performance(t.quads, GRID)


@query("sweep_performance", _SWEPT_SQL + "SELECT eps, eer, ap, ndcg, mean_sim, bases FROM whole")
def _sweep_performance(t: Tables):
    """The whole sweep: cluster, project and rank at every eps."""
    return performance(t).select("eps", "eer", "ap", "ndcg", "mean_sim", "bases")


@query("best_eps", _SWEPT_SQL + """SELECT eer, ap, ndcg, mean_sim, eps FROM whole
    ORDER BY eer, ap, ndcg, mean_sim, eps LIMIT 1""")
def _best_eps(t: Tables):
    return sweep.best_eps(performance(t))
