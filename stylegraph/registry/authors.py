"""Queries over author scoring and author splits; 50 authors on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stylegraph.operators import attribution as A
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.registry.evaluation import curve
from stylegraph.sources.documents import write_scores
from stylegraph.sources.staging import scratch_root


def sides(t: Tables):
    rows = t.docs50.select("author_id", "document_id", "embedding", "side")
    return rows.filter("side = 0").drop("side"), rows.filter("side = 1").drop("side")


def truth(t: Tables):
    authors = t.docs50.select("author_id").distinct()
    return authors.select(F.col("author_id").alias("query_author"),
                          F.col("author_id").alias("candidate_author"))


CELLS = """cells AS (SELECT q.author_id AS query_author, c.author_id AS candidate_author,
    avg(list_cosine_similarity(q.embedding, c.embedding)) AS score
    FROM docs50 q JOIN docs50 c ON q.side = 0 AND c.side = 1 GROUP BY 1, 2)"""
_TOP = """SELECT query_author, candidate_author, rank, round(score, 6) + 0.0 AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_author
    ORDER BY round(score, 9) DESC, candidate_author) AS rank FROM cells)"""


@query("author_pair_score", with_("docs50", extra=CELLS) + _TOP + " WHERE rank <= 10")
def _author_pair_score(t: Tables):
    return A.author_pair_score(*sides(t), 10).select(
        "query_author", "candidate_author", "rank", r6("score", "score"))


@query("query_candidate_pairs", with_("docs50", extra=CELLS) + _TOP + " WHERE rank <= 1")
def _query_candidate_pairs(t: Tables):
    return A.author_pair_score(*sides(t), 1).select(
        "query_author", "candidate_author", "rank", r6("score", "score"))


@query("attribution_scores", with_("docs50", extra=CELLS) + _TOP)
def _attribution_scores(t: Tables):
    queries, candidates = sides(t)
    return A.author_pair_score(queries, candidates, candidates.select("author_id").distinct().count()).select(
        "query_author", "candidate_author", "rank", r6("score", "score"))


@query("write_scores", with_("docs50", extra=CELLS) + """SELECT query_author, candidate_author,
    round(score, 6) + 0.0 AS score FROM (""" + _TOP + ") WHERE rank <= 20")
def _write_scores(t: Tables):
    path = f"{scratch_root(t.spark)}/stylegraph/scores-{uuid.uuid4().hex}"
    write_scores(A.author_pair_score(*sides(t), 20), path)
    return t.spark.read.parquet(path).select("query_author", "candidate_author", r6("score", "score"))


@query("mask_pairs", with_("docs50", extra=CELLS) + """SELECT query_author, candidate_author,
    CASE WHEN query_author % 5 = candidate_author % 5 THEN round(score, 6) + 0.0 ELSE 0.0 END AS score
    FROM (""" + _TOP + ") WHERE rank <= 20")
def _mask_pairs(t: Tables):
    authors = t.docs50.select("author_id").distinct()
    assigned = authors.select(F.col("author_id").alias("query_author"), (F.col("author_id") % 5).alias("k")).join(
        authors.select(F.col("author_id").alias("candidate_author"), (F.col("author_id") % 5).alias("k")), "k")
    scores = A.author_pair_score(*sides(t), 20)
    return A.mask_pairs(scores, assigned).select(
        "query_author", "candidate_author", r6("score", "score"))


def eer_auc_sql(table: str, *more: str) -> str:
    return with_("docs50", extra=",\n".join([CELLS, *more]) + f""",
    bins AS (SELECT 0 AS k, round(score, 6) + 0.0 AS score,
        count(*) FILTER (WHERE query_author = candidate_author) AS pos,
        count(*) FILTER (WHERE query_author <> candidate_author) AS neg FROM {table} GROUP BY 2),""" + curve("k")) + """
    SELECT round(eer, 6) AS eer, (SELECT round(sum(b.pos * (below + b.neg / 2)) / (sum(b.pos) * sum(b.neg)), 6)
    FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS below FROM bins) b) AS auc FROM eers"""


_AUC = eer_auc_sql("cells")


@query("attribution_eer_auc", _AUC)
def _eer_auc(t: Tables):
    bins = A.score_bins(*sides(t), truth(t))
    return A.attribution_eer_auc(bins).select(r6("eer", "eer"), r6("auc", "auc"))


@query("attribute_then_explain", _AUC)
def _attribute(t: Tables):
    path = f"{scratch_root(t.spark)}/stylegraph/scores-{uuid.uuid4().hex}"
    return A.attribute_and_evaluate(*sides(t), truth(t), path, 50).select(r6("eer", "eer"), r6("auc", "auc"))


# pairs of authors that may be compared; every fourth author misses the right candidate
MASKED = """masked AS (SELECT query_author, candidate_author, CASE WHEN
        (query_author % 5 = candidate_author % 5 OR query_author % 7 = candidate_author % 3)
        AND (query_author % 4 <> 1 OR query_author <> candidate_author) THEN score ELSE 0 END AS score FROM cells)"""


def assigned(t: Tables):
    authors = t.docs50.select("author_id").distinct()

    def by(query: int, candidate: int):
        return authors.select(F.col("author_id").alias("query_author"), (F.col("author_id") % query).alias("k")).join(
            authors.select(F.col("author_id").alias("candidate_author"), (F.col("author_id") % candidate).alias("k")), "k").drop("k")
    return by(5, 5).unionByName(by(7, 3)).filter("query_author % 4 <> 1 OR query_author <> candidate_author").distinct()


@query("attribute_masked", eer_auc_sql("masked", MASKED))
def _attribute_masked(t: Tables):
    path = f"{scratch_root(t.spark)}/stylegraph/scores-{uuid.uuid4().hex}"
    return A.attribute_and_evaluate(*sides(t), truth(t), path, 50, assigned(t)).select(r6("eer", "eer"), r6("auc", "auc"))


@query("training_pairs", with_("docs50") + """SELECT 'query' AS kind, author_id AS query_author,
    NULL::BIGINT AS candidate_author, count(*) * (count(*) - 1) // 2 AS pairs FROM docs50 WHERE side = 0 GROUP BY 2
    UNION ALL SELECT 'candidate', NULL, author_id, count(*) * (count(*) - 1) // 2 FROM docs50 WHERE side = 1 GROUP BY 3
    UNION ALL SELECT 'match', author_id, author_id, count(*) FILTER (WHERE side = 0) * count(*) FILTER (WHERE side = 1)
    FROM docs50 GROUP BY author_id""")
def _training_pairs(t: Tables):
    return A.training_pair_counts(*sides(t), truth(t))


@query("matched_cross_pairs", with_("docs50") + """SELECT author_id AS query_author, author_id AS candidate_author,
    count(*) FILTER (WHERE side = 0) * count(*) FILTER (WHERE side = 1) AS pairs FROM docs50 GROUP BY author_id""")
def _matched_cross_pairs(t: Tables):
    return A.training_pair_counts(*sides(t), truth(t)).filter("kind = 'match'").drop("kind")


SPLIT = """shares AS (SELECT DISTINCT author_id, CASE WHEN ('0x' || substr(md5(author_id::VARCHAR), 1, 8))::BIGINT
    % 1000 < 150 THEN 'valid' ELSE 'train' END AS split FROM docs50)"""


def link(t: Tables):
    """Query authors below 30 match the candidate ten above."""
    authors = t.docs50.select("author_id").distinct().filter("author_id < 30")
    return authors.select(F.col("author_id").alias("query_author"),
                          (F.col("author_id") + 10).alias("candidate_author"))


PLACED = SPLIT + """,
    placed AS (SELECT 'query' AS role, split, author_id FROM shares
        UNION ALL SELECT 'candidate', split, author_id + 10 FROM shares WHERE author_id < 30
        UNION ALL SELECT 'candidate', split, author_id FROM shares WHERE author_id < 10 OR author_id >= 40)"""


@query("split_authors", with_("docs50", extra=PLACED) + "SELECT role, split, author_id FROM placed")
def _split_authors(t: Tables):
    return A.split_authors(*sides(t), link(t))


@query("split_matches", with_("docs50", extra=PLACED) + """SELECT q.split, q.author_id AS query_author,
    c.author_id AS candidate_author FROM placed q JOIN placed c ON q.role = 'query' AND c.role = 'candidate'
    AND c.split = q.split AND c.author_id = q.author_id + 10 AND q.author_id < 30""")
def _split_matches(t: Tables):
    return A.split_matches(link(t), A.split_authors(*sides(t), link(t)))


@query("authors_in_split", with_("docs50", extra=SPLIT) + """SELECT author_id, document_id FROM docs50
    WHERE side = 0 AND author_id IN (SELECT author_id FROM shares WHERE split = 'valid')""")
def _authors_in_split(t: Tables):
    split = A.split_authors(*sides(t), link(t)).filter("role = 'query' and split = 'valid'")
    return A.authors_in_split(sides(t)[0], split).select("author_id", "document_id")


@query("leftover_candidates", with_("docs50") + """SELECT DISTINCT author_id FROM docs50 WHERE side = 1
    AND (author_id < 10 OR author_id >= 40)""")
def _leftover(t: Tables):
    placed = link(t).select(F.col("candidate_author").alias("author_id"))
    return A.leftover_candidates(sides(t)[1], placed)
