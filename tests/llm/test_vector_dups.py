import math

import numpy as np
from conftest import FOLDER

from stylegraph.llm import vector_dups
from stylegraph.llm.queries import QUERIES
from stylegraph.llm.vector_dups import MultiIndex, codebook, forest, nearest, vector_duplicates

SCHEMA = "vec_id bigint, embedding array<float>, label int, unit string, node string, copies int"


def brute(rows, threshold=0.93):
    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)
    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
              and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return out


def made(n=400, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    rows = []
    for i in range(n):
        c = centres[rng.integers(30)]
        v = c / np.linalg.norm(c) + rng.choice([0.0, 0.02, 0.07, 0.3]) * rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], int(rng.integers(3))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def test_recall_and_no_false_links(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "CHUNK", 16)
    rows = made()
    want = {r[0]: r for r in brute(rows)}
    got = {r.vec_id: r for r in vector_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= want[i][1] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(w[1] for w in want.values())
    assert np.mean([got[i].component_id == want[i][2] for i in got]) > 0.97


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0, 0.5]
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0] * 4, 0),
            (7, [1.0, None, 3.0, 0.5], 0), (8, [float("nan"), 1.0, 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0, 1.0], 0),
            (None, [2.0, 4.0, 6.0, 1.0], 0), (10, [1.0, 2.0], 0), (11, [], 0), (12, [1.0, 2.0], 0), (13, [-c for c in one], 0),
            (14, [1e-38, 2e-38, 3e-38, 5e-39], 0), (15, [5.0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert vector_duplicates(frame(spark, [])).count() == 0
    assert vector_duplicates(frame(spark, [(1, None, 0)])).collect()[0].kept


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in QUERIES["op5_multi_index_dedup"](spark, FOLDER).collect())
    assert got == sorted(brute(rows))


def test_walk_goes_by_distance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x, 0.9, 0.99, 16)
    first, second = index.distances(x[:20])
    for a, b in zip(first, second):
        cells = index.walk(a, b)
        total = (a[:, None] + b[None, :]).ravel()
        sums = total[cells]
        assert (np.diff(sums) >= 0).all()
        assert set(cells) == set(np.flatnonzero(total <= a.min() + b.min() + index.bound).tolist())
    assert nearest(x, codebook(x, 32)).min(1).mean() < nearest(x, x[:32]).min(1).mean()


def test_forest_spans():
    rng = np.random.default_rng(2)
    hit = rng.random((30, 40)) < 0.05
    xs, ys = forest(hit)
    assert all(hit[x, y] for x, y in zip(xs, ys))

    def groups(pairs):
        parent = list(range(70))

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v
        for x, y in pairs:
            parent[max(root(x), root(y + 30))] = min(root(x), root(y + 30))
        return [root(v) for v in range(70)]
    assert groups(zip(xs, ys)) == groups(zip(*np.nonzero(hit)))
