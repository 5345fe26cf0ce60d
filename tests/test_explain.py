"""Ranks by counting and explanations against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.plans import explain

SPACES = "id bigint, latent array<double>, interp array<double>"


def made(n=60, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v, w = rng.normal(size=5), rng.normal(size=2)
        rows.append([i * 3, (v / np.linalg.norm(v)).tolist(), (w / np.linalg.norm(w)).tolist()])
    for i in (7, 20, 33):                      # copies tie with each other in one or both spaces
        rows[i][1:] = rows[5][1:]
    rows[41][2] = rows[5][2]
    return rows


def brute(rows, queries):
    out = {}
    for q in queries:
        mine = next(r for r in rows if r[0] == q)
        places = []
        for c in (1, 2):
            scored = sorted(((-round(float(np.dot(mine[c], r[c])), 9), r[0]) for r in rows if r[0] != q))
            places.append({i: k + 1 for k, (_, i) in enumerate(scored)})
        out.update({(q, i): (places[0][i], places[1][i]) for i in places[0]})
    return out


@pytest.mark.parametrize("block_rows", [8, 8192])
def test_ranks_of_given_matches(spark, monkeypatch, block_rows):
    monkeypatch.setattr(explain, "MATCHES_A_ROW", 16)
    rows = made()
    want = brute(rows, [15, 21, 60])
    spaces = spark.createDataFrame(rows, SPACES)
    matches = spark.createDataFrame(list(want), "query_id bigint, candidate_id bigint")
    got = explain.rank_matches(spaces, matches, block_rows).collect()
    assert {(r.query_id, r.candidate_id): (r.latent_rank, r.interp_rank) for r in got} == want


def test_best_candidates_in_either_space(spark):
    rows = made()
    want = {k: v for k, v in brute(rows, [0, 15]).items() if min(v) <= 4}
    got = explain.rank_candidates(spark.createDataFrame(rows, SPACES),
                                  spark.createDataFrame([(0,), (15,)], "query_id bigint"), 4).collect()
    assert {(r.query_id, r.candidate_id): (r.latent_rank, r.interp_rank) for r in got} == want
    none = explain.rank_candidates(spark.createDataFrame([], SPACES), spark.createDataFrame([(0,)], "query_id bigint"), 4)
    assert none.count() == 0


def test_explanations_are_readable(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.9, 0.0]), (3, [0.0, 1.0])], "id bigint, vector array<double>")
    centroids = spark.createDataFrame([(-1, [1.0, 1.0]), (0, [2.0, 0.0]), (1, [0.0, 3.0])], "cluster_label bigint, centroid array<double>")
    weights = spark.createDataFrame([(0, "short", 1.0), (0, "plain", 2.0), (0, "rare", 0.5), (-1, "noise", 9.0)],
                                    "cluster_label bigint, feature string, weight double")
    asked = spark.createDataFrame([(1,)], "query_id bigint")
    rows = explain.explain_prediction(docs, asked, centroids, weights, top_c=2, top_k=2, candidates=2).orderBy(
        "latent_rank", "rank").collect()
    assert [(r.candidate_id, r.latent_rank, r.rank, r.cluster_label) for r in rows] == [
        (2, 1, 1, 0), (2, 1, 2, 1), (3, 2, 1, 0), (3, 2, 2, 1)]
    assert rows[0].features == ["plain", "short"] and rows[0].summary == "plain - short" and rows[1].summary is None
    assert (rows[0].query_score, rows[0].score) == pytest.approx((1.0, 0.9))
    said = explain.cluster_texts(weights, 2, lambda instruction, text: f"[{text}]").collect()
    assert [(r.cluster_label, r.summary) for r in said] == [(0, "[plain\nshort]")]


def test_authors_are_all_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{i % 4}", i, rng.normal(size=3).tolist()) for i in range(20)]
    docs = spark.createDataFrame(rows, "author_id string, id bigint, vector array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.2, 0.0]), (1, [0.0, 0.3, 1.0])], "cluster_label bigint, centroid array<double>")
    weights = spark.createDataFrame([(0, "f", 1.0), (1, "g", 1.0)], "cluster_label bigint, feature string, weight double")
    got = explain.explain_prediction_authors(docs, centroids, weights, top_c=1, candidates=9)
    assert got.select("query_id").distinct().count() == 4 and got.count() == 12
    unit = {(a, i): np.array(v) / np.linalg.norm(v) for a, i, v in rows}
    for r in got.collect():
        def mean(a, b):
            return np.mean([x @ y for (p, _), x in unit.items() for (q, _), y in unit.items() if p == a and q == b])
        ahead = sum(mean(r.query_id, f"a{k}") > mean(r.query_id, r.candidate_id) + 1e-9 for k in range(4) if f"a{k}" != r.query_id)
        assert r.latent_rank == ahead + 1
    one = explain.explain_prediction_authors(docs, centroids, weights, top_c=1, candidates=9,
                                             query_ids=docs.filter(F.col("author_id") == "a1").select(F.lit("a1").alias("query_id")).distinct())
    assert {r.query_id for r in one.collect()} == {"a1"}
