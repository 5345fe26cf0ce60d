"""Queries over contrastive selection; vectors of 10 labelled classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylegraph.operators import contrast as K
from stylegraph.operators import tfidf
from stylegraph.operators.hooks import encode_documents
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.registry.space import EPS, author_labels, clustered_docs, means_cte, space
from stylegraph.sources.staging import settle


def items(t: Tables):
    return t.docs50.select(F.col("document_id").alias("id"),
                           F.col("label").cast("bigint").alias("class"),
                           F.col("embedding").alias("vector"), "side")


def universe(t: Tables):
    """The query side is the universe, three of its items are selected."""
    return items(t).filter("side = 0"), items(t).filter("id in (3, 101, 205)").select("id")


UNIT = """u AS (SELECT document_id AS id, label AS class, side, list_transform(embedding,
    lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM docs50)"""
STATE = UNIT + """,
    s AS (SELECT * FROM u WHERE id IN (3, 101, 205)),
    to_v AS (SELECT a.id, avg(list_dot_product(a.v, b.v)) AS tv FROM u a JOIN u b ON b.side = 0 GROUP BY 1),
    to_s AS (SELECT a.id, avg(list_dot_product(a.v, b.v)) AS ts FROM u a, s b GROUP BY 1),
    to_p AS (SELECT a.id, avg(list_dot_product(a.v, b.v)) AS tp FROM u a JOIN u b ON b.side = 1 GROUP BY 1),
    g AS (SELECT avg(tv) AS vs FROM to_v WHERE id IN (3, 101, 205)),
    h AS (SELECT avg(list_dot_product(a.v, b.v)) AS ss FROM s a, s b),
    x AS (SELECT u.id, tv, ts, tp, vs, ss, 4.0 AS m, list_dot_product(u.v, u.v) AS own FROM u JOIN to_v ON to_v.id = u.id
        JOIN to_s ON to_s.id = u.id JOIN to_p ON to_p.id = u.id, g, h WHERE u.id NOT IN (3, 101, 205))"""
MMD = "(2 * tv - own / m - 2 * vs + (2 * (m - 1) / m + 1 / m) * ss - 2 * (m - 1) / m * ts) / m"
DIV = "(-own / m + (2 * (m - 1) / m + 1 / m) * ss - 2 * (m - 1) / m * ts) / m"


def gains(t: Tables):
    rows = items(t)
    base, picked = universe(t)
    return K.gain_inputs(rows, base, picked, rows.filter("side = 1"))


def _gain(expr: str) -> str:
    return with_("docs50", extra=STATE) + f"SELECT id, round({expr}, 6) + 0.0 AS gain FROM x"


@query("gain_mmd", _gain(MMD))
def _mmd(t: Tables):
    return gains(t).select("id", r6(K.gain_mmd(), "gain"))


@query("gain_ekxs", _gain("(tv - vs) / m"))
def _ekxs(t: Tables):
    return gains(t).select("id", r6(K.gain_ekxs(), "gain"))


@query("gain_div", _gain(DIV))
def _div(t: Tables):
    return gains(t).select("id", r6(K.gain_div(), "gain"))


@query("gain_kxs", _gain("tv"))
def _kxs(t: Tables):
    return gains(t).select("id", r6(K.gain_kxs(), "gain"))


@query("gain_critic", _gain("abs(tv - tp)"))
def _critic(t: Tables):
    return gains(t).select("id", r6(K.gain_critic(), "gain"))


@query("gain_combine", _gain(f"{MMD} - 0.5 * {DIV} + 0.1 * (tv - tp)"))
def _combine(t: Tables):
    total = K.combine((1, K.gain_mmd()), (-0.5, K.gain_div()), (0.1, K.gain_critic(False)),
                      (2, K.gain_dummy()))
    return gains(t).select("id", r6(total, "gain"))


@query("gain_nn", with_("docs50", extra=STATE) + """,
    best AS (SELECT b.id, b.v, max(list_dot_product(b.v, a.v)) AS w FROM u b, s a WHERE b.side = 0 GROUP BY 1, 2)
    SELECT u.id, round(sum(greatest(list_dot_product(u.v, b.v), w) - w), 6) + 0.0 AS gain FROM u, best b
    WHERE u.id NOT IN (3, 101, 205) GROUP BY u.id""")
def _nn(t: Tables):
    base, picked = universe(t)
    return K.gain_nn(items(t), base, picked).select("id", r6("gain", "gain"))


@query("gain_logdet", with_("docs50", extra=UNIT) + """
    SELECT a.id, round(ln(greatest(abs(list_dot_product(a.v, a.v) - list_dot_product(a.v, b.v) ** 2
        / list_dot_product(b.v, b.v)), 1e-12)), 6) + 0.0 AS gain FROM u a JOIN u b ON b.id = 3 WHERE a.id <> 3""")
def _logdet(t: Tables):
    return K.gain_logdet(items(t), items(t).filter("id = 3").select("id")).select("id", r6("gain", "gain"))


@query("kernel_pairs", with_("docs50", extra=UNIT) + """
    SELECT a.id, round(avg(list_dot_product(a.v, b.v)) + 0.5 / count(*), 6) + 0.0 AS cosine_mean,
        round(any_value(list_dot_product(a.v, a.v)) + 0.5, 6) AS diagonal,
        round(avg(exp(-0.7 * list_distance(a.e, b.e) ** 2)), 6) AS rbf_mean
    FROM (SELECT u.id, u.v, d.embedding AS e FROM u JOIN docs50 d ON d.document_id = u.id) a,
         (SELECT u.id, u.v, d.embedding AS e FROM u JOIN docs50 d ON d.document_id = u.id) b GROUP BY a.id""")
def _kernel(t: Tables):
    rows = items(t).select("id", "vector")
    cosine = K.kernel_row_means(rows, ridge=0.5).select("id", r6("mean", "cosine_mean"),
                                                        r6("diagonal", "diagonal"))
    rbf = K.kernel_row_means(rows, gamma=0.7).select("id", r6("mean", "rbf_mean"))
    return cosine.join(rbf, "id")


@query("class_complement", with_("docs50") + "SELECT document_id AS id FROM docs50 WHERE label <> 3")
def _complement(t: Tables):
    return K.class_complement(items(t).select("id"), items(t).filter("class = 3"))


@query("farthest_first_seeds", with_("docs50", recursive=True, extra="""
    walk AS (SELECT 1::BIGINT AS seed, [0::BIGINT] AS chosen
        UNION ALL SELECT w.seed + 1, list_append(w.chosen, (SELECT arg_min(id, (-far, id)) FROM (
            SELECT d.document_id AS id, round(min(list_distance(d.embedding, c.embedding)), 9) AS far
            FROM docs50 d JOIN docs50 c ON list_contains(w.chosen, c.document_id) GROUP BY 1)))
        FROM walk w WHERE w.seed < 5)""") + """
    SELECT unnest(generate_series(1, 5)) AS seed, unnest(chosen) AS id FROM walk WHERE seed = 5""")
def _seeds(t: Tables):
    return K.farthest_first_seeds(items(t), 5, 0)


def greedy_sql(k: int, group: str, weight: float, kind: str = "mmd") -> str:
    """The first ``k`` greedy picks per group, one step after the other."""
    def gain(mean: str, back: str, m: int) -> str:
        inside = f"+ {2 * (m - 1) / m + 1 / m} * ss - {2 * (m - 1) / m} * ts" if m > 1 else ""
        past = f"- {back}" if m > 1 else ""
        return {"mmd": f"(2 * {mean} - own / {m} {past} {past} {inside}) / {m}", "ekxs": f"({mean} {past}) / {m}",
                "div": f"(-own / {m} {inside}) / {m}", "kxs": mean}[kind]

    parts = [UNIT, f"""w AS (SELECT id, {group} AS class, v FROM u),
    d AS (SELECT a.class, a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS k FROM w a JOIN w b ON b.class = a.class),
    c AS (SELECT a.class, a.id, avg(list_dot_product(a.v, b.v)) FILTER (WHERE b.class = a.class) AS tv,
        coalesce(avg(list_dot_product(a.v, b.v)) FILTER (WHERE b.class <> a.class), 0) AS tc,
        any_value(list_dot_product(a.v, a.v)) AS own FROM w a, w b GROUP BY 1, 2)"""]
    for m in range(1, k + 1):
        taken = " UNION ALL ".join(f"SELECT class, id FROM pick{i}" for i in range(1, m))
        score = f"round({gain('tv', 'vs', m)} - {weight} * ({gain('tc', 'cs', m)}), 12)"
        if m > 1:
            parts.append(f"""t{m} AS ({taken}),
    g{m} AS (SELECT class, avg(tv) AS vs, avg(tc) AS cs FROM t{m} JOIN c USING (class, id) GROUP BY class),
    h{m} AS (SELECT a.class, avg(d.k) AS ss FROM t{m} a JOIN t{m} b ON b.class = a.class
        JOIN d ON d.i = a.id AND d.j = b.id GROUP BY 1),
    s{m} AS (SELECT d.i AS id, avg(d.k) AS ts FROM d JOIN t{m} t ON t.id = d.j GROUP BY 1)""")
            source = (f"c JOIN g{m} USING (class) JOIN h{m} USING (class) JOIN s{m} USING (id) "
                      f"WHERE id NOT IN (SELECT id FROM t{m})")
        else:
            source = "c"
        parts.append(f"""pick{m} AS (SELECT class, arg_min(id, (-gain, id)) AS id, max(gain) AS gain
        FROM (SELECT class, id, {score} AS gain FROM {source}) GROUP BY class)""")
    steps = " UNION ALL ".join(
        f"SELECT class, {m}::BIGINT AS step, id, round(gain, 6) + 0.0 AS gain FROM pick{m}"
        for m in range(1, k + 1))
    return with_("docs50", extra=",\n".join(parts)) + f"SELECT * FROM ({steps})"


@query("greedy_select_by_class", greedy_sql(3, "class::BIGINT", 0.1))
def _greedy(t: Tables):
    return K.greedy_select_by_class(items(t), 3, 0.1).select("class", "step", "id", r6("gain", "gain"))


@query("greedy_select", "SELECT step, id, gain FROM (" + greedy_sql(3, "0", 0.0) + ")")
def _greedy_all(t: Tables):
    return K.greedy_select(items(t), 3).select("step", "id", r6("gain", "gain"))


def greedy_query(kind: str, sql: str):
    @query(f"greedy_{kind}", sql)
    def run(t: Tables):
        return K.greedy_select(items(t), 3, kind, batch=64).select("step", "id", r6("gain", "gain"))


for _kind in ("ekxs", "div", "kxs"):
    greedy_query(_kind, "SELECT step, id, gain FROM (" + greedy_sql(3, "0", 0.0, _kind) + ")")

_KERNEL = UNIT + """,
    d AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS k FROM u a, u b)"""
_PICK = """pick{n} AS (SELECT {n}::BIGINT AS step, arg_min(id, (-round(gain, 12), id)) AS id, max(round(gain, 12)) AS gain
        FROM g{n} WHERE {free})"""


def _steps(gains: list[str]) -> str:
    parts = [_KERNEL]
    for n, gain in enumerate(gains, 1):
        free = " AND ".join(f"id <> (SELECT id FROM pick{m})" for m in range(1, n)) or "true"
        parts += [gain, _PICK.format(n=n, free=free)]
    picked = " UNION ALL ".join(f"SELECT * FROM pick{n}" for n in range(1, len(gains) + 1))
    return with_("docs50", extra=",\n".join(parts)) + f"SELECT step, id, round(gain, 6) + 0.0 AS gain FROM ({picked})"


# what the selection leaves of an item's variance, one column of the Cholesky factor per pick
greedy_query("logdet", _steps([
    "g1 AS (SELECT i AS id, ln(k) AS gain FROM d WHERE i = j)",
    """e1 AS (SELECT i, k / sqrt((SELECT k FROM d WHERE i = j AND i = (SELECT id FROM pick1))) AS e FROM d WHERE j = (SELECT id FROM pick1)),
    v2 AS (SELECT d.i, d.k - e.e * e.e AS v FROM d JOIN e1 e ON e.i = d.i WHERE d.i = d.j),
    g2 AS (SELECT i AS id, ln(greatest(abs(v), 1e-12)) AS gain FROM v2)""",
    """e2 AS (SELECT d.i, (d.k - e.e * (SELECT e FROM e1 WHERE i = (SELECT id FROM pick2)))
        / sqrt((SELECT v FROM v2 WHERE i = (SELECT id FROM pick2))) AS e FROM d JOIN e1 e ON e.i = d.i WHERE d.j = (SELECT id FROM pick2)),
    g3 AS (SELECT v.i AS id, ln(greatest(abs(v.v - e.e * e.e), 1e-12)) AS gain FROM v2 v JOIN e2 e ON e.i = v.i)"""]))
# how much an item raises the best similarity of each row to the selection
greedy_query("nn", _steps([
    "g1 AS (SELECT i AS id, sum(k) AS gain FROM d GROUP BY i)",
    """h1 AS (SELECT i, k AS h FROM d WHERE j = (SELECT id FROM pick1)),
    g2 AS (SELECT d.i AS id, sum(greatest(d.k - h.h, 0)) AS gain FROM d JOIN h1 h ON h.i = d.j GROUP BY 1)""",
    """h2 AS (SELECT d.i, greatest(d.k, h.h) AS h FROM d JOIN h1 h ON h.i = d.i WHERE d.j = (SELECT id FROM pick2)),
    g3 AS (SELECT d.i AS id, sum(greatest(d.k - h.h, 0)) AS gain FROM d JOIN h2 h ON h.i = d.j GROUP BY 1)"""]))


@query("contrastive_representation")
def _contrastive(t: Tables):
    features = tfidf.cluster_feature_set(t.assignments, clustered_docs(t))
    words = settle(encode_documents(features.select("feature").distinct(), "feature", size=64, n=2), "words")
    rows = features.join(words.select("feature", F.col("embedding").alias("vector")), "feature")
    return K.contrastive_representation(rows, 3, 0.1)
