"""Ranking metrics against direct formulas, in and out of the task."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.operators import metrics, sweep


def direct(scores, hits):
    """EER, AP and NDCG spelled out point by point."""
    groups = sorted(set(scores), reverse=True)
    p, n = sum(hits), len(hits) - sum(hits)
    if not p:
        return 1.0, 0.0, 0.0
    points, tp, fp, ap = [], 0, 0, 0.0
    rank, dcg = 0, 0.0
    for g in groups:
        here = [h for s, h in zip(scores, hits) if s == g]
        tp, fp = tp + sum(here), fp + len(here) - sum(here)
        ap += sum(here) / p * tp / (tp + fp)
        dcg += sum(here) / len(here) * sum(1 / np.log2(rank + i + 2) for i in range(len(here)))
        rank += len(here)
        points.append((fp, tp))
    ndcg = dcg / sum(1 / np.log2(i + 2) for i in range(p))
    if not n:
        return 1.0, ap, ndcg
    kept = [points[0]]
    for a, b, c in zip(points, points[1:], points[2:]):
        if any(c[i] - 2 * b[i] + a[i] for i in (0, 1)):
            kept.append(b)
    if len(points) > 1:
        kept.append(points[-1])
    curve = [(1.0, 0.0)] + [(1 - t / p, f / n) for f, t in kept]
    best = min(range(len(curve)), key=lambda i: (round(abs(curve[i][0] - curve[i][1]), 12), i))
    return sum(curve[best]) / 2, ap, ndcg


def test_rankings_with_ties(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for q in range(40):
        n = int(rng.integers(2, 30))
        scores = [float(x) for x in np.round(rng.random(n), 1 if q % 2 else 3)]
        hits = [int(x) for x in rng.random(n) < (0.3 if q else 0)]
        rows += [(q, s, h) for s, h in zip(scores, hits)]
        want[q] = direct(scores, hits)
    want_all = {q: v for q, v in want.items()}
    ranked = spark.createDataFrame(rows, "q bigint, score double, hit int")
    bins = metrics.score_bins(ranked, ["q"])
    for r in metrics.ranking_metrics(bins, ["q"]).collect():
        assert (r["eer"], r["ap"], r["ndcg"]) == pytest.approx(want_all[r["q"]], abs=1e-9)
    discounts = np.r_[0.0, np.cumsum(1 / np.log2(np.arange(1, 60) + 1.0))]
    for q in range(40):
        s = np.array([x[1] for x in rows if x[0] == q])
        h = np.array([x[2] for x in rows if x[0] == q])
        assert metrics.rank_one(s, h, discounts) == pytest.approx(want_all[q], abs=1e-9)


def test_leave_one_out_streams_to_the_same_ranks(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=4)] for _ in range(90)]
    vectors[50] = vectors[3]                                  # an exact copy ties
    vectors[60] = [2 * x for x in vectors[3]]
    docs = [(s, i, f"a{i % 7 if i > 40 else 0}", vectors[i]) for s in (0, 1) for i in range(90) if not (s and i % 3)]
    docs.append((2, 7, "lonely", vectors[0]))
    frame = spark.createDataFrame(docs, "space int, id bigint, author_id string, vector array<double>")
    want = {}
    for s, i, author, v in docs:
        others = [r for r in docs if r[0] == s and r[1] != i]
        cos = [round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12) for *_, w in others]
        hits = [int(r[2] == author) for r in others]
        mean = np.mean([c for c, h in zip(cos, hits) if h]) if any(hits) else None
        want[s, i] = (sum(hits), len(hits) - sum(hits), mean, *direct(cos, hits))
    for tile_bytes in (1, 9 * 90 * 20, 128 << 20):            # one query a tile, twenty, all
        got = metrics.leave_one_out(frame, tile_bytes).collect()
        assert len(got) == len(docs)
        for r in got:
            assert tuple(r)[2:] == pytest.approx(want[r.space, r.id], abs=1e-9)
    assert metrics.leave_one_out(frame.limit(0)).count() == 0


def test_sweep_metrics_per_space(spark):
    docs = spark.createDataFrame([(e, i, i % 2, [1.0, float(i % 2) * e]) for e in (1.0, 2.0) for i in range(6)],
                                 "space double, id bigint, author_id bigint, vector array<double>")
    got = {r.space: r for r in metrics.sweep_metrics(docs).collect()}
    assert set(got) == {1.0, 2.0} and all(r.ap == r.ndcg == 1.0 and r.eer == 0.0 for r in got.values())
    one = metrics.model_performance(docs.filter("space = 2").drop("space")).first()
    assert tuple(one) == tuple(got[2.0])[1:]


def test_auc_counts_ties_half(spark):
    bins = spark.createDataFrame([(0.9, 2, 0), (0.5, 1, 1), (0.1, 0, 3)],
                                 "score double, pos bigint, neg bigint")
    assert metrics.auc(bins).first()["auc"] == pytest.approx((2 * 4 + 3 + 0.5) / 12)


def test_first_minimal_change_example(spark):
    rows = [("m", 1, 0.512, 0.001, 0.145), ("m", 3, 0.299, 0.01, 0.172), ("m", 8, 0.246, 0.021, 0.196),
            ("m", 21, 0.126, 0.126, 0.33), ("m", 40, 0.12, 0.13, 0.335)]
    df = spark.createDataFrame(rows, "method string, k int, a double, b double, c double")
    got = sweep.first_minimal_change(df, "k", ["a", "b", "c"], 0.02, ["method"]).first()
    assert got["k"] == 21
    assert sweep.first_minimal_change(df, "k", ["a", "b", "c"], 1e-6, ["method"]).first()["k"] is None


def test_stable_and_optimal_points(spark):
    ys = [9.0, 4.0, 4.1, 4.0, 4.1, 4.0, 1.0]
    df = spark.createDataFrame([("m", i, y) for i, y in enumerate(ys)], "method string, x int, y double")
    assert sweep.stable_point(df, "x", "y", ["method"]).first()["stable_x"] == 4
    assert sweep.optimal_stable_point(df, "x", "y", True, ["method"]).first()["point"] == 0
    assert sweep.optimal_stable_point(df, "x", "y", False, ["method"]).first()["point"] == 4
    chosen = sweep.select_sweep_point(df, "x", {"y": False}, ["method"]).first()
    assert (chosen["x"], chosen["y"]) == (4, 4.1)


def test_best_eps_takes_the_smallest_tuple(spark):
    df = spark.createDataFrame([(0.3, 0.1, 0.2, 0.5, 0.1), (0.2, 0.1, 0.2, 0.5, 0.1), (0.1, 0.2, 0.0, 0.0, 0.0)],
                               "eps double, eer double, ap double, ndcg double, mean_sim double")
    assert sweep.best_eps(df).first()["eps"] == 0.2


def test_narrow_bases_keep_the_products(spark):
    # 9 000 bases of 6 numbers are three parts of a factor; vectors of 9 000 scores went to every tile before
    import numpy as np
    from stylegraph.plans import explain
    rng = np.random.default_rng(3)
    bases, docs = rng.normal(size=(9000, 6)) + 0.3, rng.normal(size=(40, 6))
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(bases)]
                                 + [(1, i, v.tolist()) for i, v in enumerate(bases[:3])], "space int, id bigint, vector array<double>")
    found = explain.narrow_bases(rows).collect()
    for space, whole, n in ((0, bases, 6), (1, bases[:3], 3)):
        narrow = np.array([r.vector for r in found if r.space == space])
        assert narrow.shape == (n, 6)
        assert np.allclose(docs @ narrow.T @ narrow @ docs.T, docs @ whole.T @ whole @ docs.T, rtol=1e-11)


def test_candidates_are_not_copied_for_each_tile(spark):
    import numpy as np
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(s, i, i // 4, rng.normal(size=3).tolist()) for s in (0.5, 0.7) for i in range(60)],
                                 "space double, id bigint, author_id bigint, vector array<double>")
    ranked = metrics.leave_one_out(docs, tile_bytes=9 * 60)
    assert "Explode" not in ranked._jdf.queryExecution().analyzed().toString() and "explode" not in ranked._jdf.queryExecution().analyzed().toString()
    assert ranked.agg(F.count_if((F.col("hits") == 3) & (F.col("misses") == 56))).first()[0] == 120


def test_ranks_by_hits_and_ties_alone():
    rng = np.random.default_rng(5)
    for n, levels in ((n, levels) for n in range(1, 30) for levels in (2, 5, 1000)):
        scores = rng.integers(0, levels, n).astype(float)
        hits = rng.random(n) < rng.choice([0.1, 0.5, 1.0])
        discounts = np.r_[0, np.cumsum(1 / np.log2(np.arange(1, n + 1) + 1))]
        assert metrics.rank_one(scores, hits, discounts) == pytest.approx(direct(scores, hits.astype(int)), abs=1e-12)
    # a hundred thousand scores are sorted once and compared once; before, a list of each distinct one was made several times
    scores = rng.normal(size=100_000)
    hits = np.arange(len(scores)) < 3
    discounts = np.ones(len(scores) + 1).cumsum()
    tracemalloc.start()
    metrics.rank_one(scores, hits, discounts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5e6
