import hashlib
import math

import numpy as np
import pytest
from conftest import FOLDER

from oracle import compare, connect
from stylegraph.llm.queries import QUERIES, SQL
from stylegraph.llm.walsh_clusters import cluster_vectors, coarse_first, nearest, restore, transform

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, coefs string, n string"


def brute(rows, k=8, rounds=10, width=64):
    """Lloyd's rounds in plain Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and abs(x) <= 131_072 for x in v):
            whole = [math.floor(1024 * float(x)) for x in v]
            name = hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
            kept.append((i, whole, (name, transform(np.array([whole]))[0].tolist())))
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: r[2])[:k]]

    def assign():
        out = []
        for _, v, _ in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        placed = assign()
        for c in range(len(centroids)):
            mine = [v for (j, _), (_, v, _) in zip(placed, kept) if j == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    placed = assign()
    return sorted([(i, c, d, sum(e for j, e in placed if j == c), sum(e for _, e in placed),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _, _), (c, d) in zip(kept, placed)], key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                               "centroid_sha256").collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    x, y = rng.integers(-5000, 5000, (2, 20, 64))
    assert (((transform(x) - transform(y)) ** 2).sum(1) == 64 * ((x - y) ** 2).sum(1)).all()
    assert restore(transform(x)[3].tolist()) == x[3].tolist()
    assert coarse_first(4).tolist() == [0, 2, 3, 1]


@pytest.mark.parametrize("spread_", [1, 40, 3000, 1 << 30])
def test_nearest_with_ties(spread_):
    rng = np.random.default_rng(1)
    c = rng.integers(-spread_, spread_ + 1, (8, 64))
    c[5] = c[2]                                         # equal centroids: the smaller number
    x = np.r_[c, c[rng.integers(8, size=500)] + rng.integers(-spread_, spread_ + 1, (500, 64)) // 2]
    found, distance, worked = nearest(transform(x), transform(c))
    plain = [[sum((int(p) - int(q)) ** 2 for p, q in zip(v, w)) for w in c] for v in x]
    assert found.tolist() == [d.index(min(d)) for d in plain]
    assert distance.tolist() == [min(d) for d in plain]


def test_search_leaves_work_out():
    rng = np.random.default_rng(2)
    base = np.repeat(rng.integers(-900, 900, (8, 8)), 8, axis=1)    # smooth, as coarse coefficients tell
    x = base[rng.integers(8, size=2000)] + rng.integers(-30, 31, (2000, 64))
    worked = nearest(transform(x), transform(base))[2]
    assert worked < 0.4 * 2000 * 8 * 64


def test_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 70, [float(np.float32(v)) for v in rng.normal(size=64) * rng.choice([0.01, 1, 30])]) for i in range(150)]
    assert result(cluster_vectors(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    one = [0.25] * 64
    rows = [(1, one), (1, one), (2, [-x for x in one]), (None, one), (3, None), (4, one[:63]), (5, one + [1.0]), (6, []),
            (7, [None] + one[1:]), (8, [float("nan")] + one[1:]), (9, [float("inf")] + one[1:]), (10, [float("-inf")] + one[1:]),
            (11, [1e30] + one[1:]), (12, [131_072.0] * 64), (13, [-131_072.0] * 64), (14, [0.0] * 64)]
    assert result(cluster_vectors(frame(spark, rows))) == brute(rows)
    assert result(cluster_vectors(frame(spark, rows[:2]))) == brute(rows[:2])
    assert result(cluster_vectors(frame(spark, []))) == [] and result(cluster_vectors(frame(spark, rows[4:11]))) == []


def test_whole_table(spark):
    name = "op13_walsh_clusters"
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None
