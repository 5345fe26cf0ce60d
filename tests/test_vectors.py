"""Vector expressions, means instead of pairs, and author splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.functions import vectors as V
from stylegraph.operators import attribution as A, metrics


def frame(spark, rows):
    return spark.createDataFrame(
        [(a, i, [float(x) for x in v]) for a, i, v in rows],
        "author_id string, document_id bigint, embedding array<double>")


def test_unit_vectors_and_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(V.l2_normalize(F.col("v")).alias("u"), V.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[0]["c"] == pytest.approx(1.0)
    assert rows[1]["u"] == [0.0, 0.0] and rows[1]["c"] == 0.0


def test_author_scores_equal_the_mean_over_pairs(spark):
    rng = np.random.default_rng(3)
    q = [(f"q{i % 3}", i, rng.normal(size=5)) for i in range(12)]
    c = [(f"c{i % 4}", i, rng.normal(size=5)) for i in range(17)]

    def mean(x, y):
        return np.mean([np.dot(u, w) / np.linalg.norm(u) / np.linalg.norm(w)
                        for a, _, u in q if a == x for b, _, w in c if b == y])

    got = A.author_pair_score(frame(spark, q), frame(spark, c), 4).collect()
    assert len(got) == 12
    for r in got:
        assert r["score"] == pytest.approx(mean(r["query_author"], r["candidate_author"]), abs=1e-12)
    matches = spark.createDataFrame([("q0", "c0"), ("q1", "c1"), ("q1", "c2")],
                                    "query_author string, candidate_author string")
    for rows in (8192, 2):
        bins = A.score_bins(frame(spark, q), frame(spark, c), matches, block_rows=rows)
        total = bins.agg(F.sum("pos"), F.sum("neg")).first()
        assert tuple(total) == (3, 9)
        hits = {("q0", "c0"), ("q1", "c1"), ("q1", "c2")}
        s = {(f"q{i}", f"c{j}"): mean(f"q{i}", f"c{j}") for i in range(3) for j in range(4)}
        want = np.mean([(s[h] > s[m]) + 0.5 * (s[h] == s[m]) for h in hits for m in s if m not in hits])
        assert A.attribution_eer_auc(bins).first()["auc"] == pytest.approx(want)


def test_split_leaves_no_author_on_both_sides(spark):
    docs = spark.createDataFrame([(f"a{i}",) for i in range(200)], "author_id string")
    matches = docs.filter("author_id < 'a5'").select(
        F.col("author_id").alias("query_author"), F.col("author_id").alias("candidate_author"))
    rows = A.split_authors(docs, docs, matches).collect()
    side = {}
    for r in rows:
        assert side.setdefault((r["role"], r["author_id"]), r["split"]) == r["split"]
    assert len(side) == 400
    for r in matches.collect():
        assert side["query", r["query_author"]] == side["candidate", r["candidate_author"]]
    assert 10 < sum(1 for (role, _), s in side.items() if role == "query" and s == "valid") < 55


def test_a_single_document_has_no_ranking(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0])], "id bigint, author_id string, vector array<double>")
    got = metrics.leave_one_out(df.selectExpr("0 AS space", "*")).first()
    assert tuple(got) == (0, 1, 0, 0, None, 1.0, 0.0, 0.0)


def test_blocks_are_read_and_not_copied(spark):
    import numpy as np
    from stylegraph.operators import blocks
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(40, 3)), rng.normal(size=(90, 3)).round(1)
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>") for x in (left, right)]
    found = blocks.top_matches(*frames, 5, block_rows=8)
    assert "xplode" not in found._jdf.queryExecution().analyzed().toString()
    want = {(i, int(j)) for i, row in enumerate(np.round(left @ right.T, 9)) for j in np.lexsort((np.arange(90), -row))[:5]}
    assert {(r.id, r.match) for r in found.collect()} == want
    seen = blocks.self_product(frames[1], lambda a, b: a.select(["_lb"]).append_column("rb", b.column("_rb")).slice(0, 1)
                               if a.num_rows <= b.num_rows else b.select(["_lb"]).append_column("rb", b.column("_rb")).slice(0, 1),
                               "l bigint, r bigint", block_rows=8)
    assert "xplode" not in seen._jdf.queryExecution().analyzed().toString()
