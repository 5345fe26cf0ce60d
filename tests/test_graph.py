"""Graph, clustering and skew helpers against brute force, on every code path."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.operators import blocks, cluster, graph, similarity, skew


def points(spark, rows, dim=6, seed=0, spread=0.15, groups=6):
    """Unit vectors around a few centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    m = centres[rng.integers(0, groups, rows)] + spread * rng.normal(size=(rows, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                               "id bigint, vector array<double>")
    return df, m


def brute_labels(m, eps):
    d = np.round(1 - m @ m.T, 9)
    label, n = {}, 0
    for i in range(len(m)):
        if i in label:
            continue
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in np.nonzero(d[x] <= eps)[0]:
                if y not in seen:
                    seen.add(int(y))
                    todo.append(int(y))
        if len(seen) == 1:
            label[i] = -1
        else:
            for x in seen:
                label[x] = n
            n += 1
    return label


def as_dict(df):
    return {r["id"]: r["cluster_label"] for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"block_rows": 20}, {"block_rows": 40}])
def test_dbscan_blocks_agree(spark, options):
    df, m = points(spark, 120)
    for eps in (0.01, 0.03):
        assert as_dict(cluster.dbscan(df, eps, **options)) == brute_labels(m, eps)


def test_pivot_join_finds_the_same_clusters(spark):
    df, m = points(spark, 200, seed=3, spread=0.05)
    eps = 0.004
    kernel, schema = similarity._forest_kernel("bigint", eps, similarity.cosine_distance)
    edges = similarity._pivot_join(df, eps, kernel, schema, block_rows=16, pivots=12)
    members = graph.connected_components(edges)
    assert as_dict(cluster._label(df.select("id"), members, [])) == brute_labels(m, eps)


def test_dbscan_ignores_partitioning_and_copies(spark):
    df, m = points(spark, 60)
    copies = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    one = as_dict(cluster.dbscan(copies.repartition(7), 0.02, block_rows=16))
    assert one == as_dict(cluster.dbscan(copies.coalesce(1), 0.02))
    assert -1 not in one.values()


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(30)]
    hub = [(100, 100 + i) for i in range(1, 40)]
    edges = spark.createDataFrame(chain + hub + [(300, 299)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    want = {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 299: 299, 300: 299}
    assert got == want


@pytest.mark.parametrize("small", [200_000, 0])
def test_spanning_forest_weight(spark, small):
    df, m = points(spark, 60, seed=5)
    limit = 0.3
    d = np.round(1 - m @ m.T, 9)
    parent, total = list(range(60)), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, i, j in sorted((d[i, j], i, j) for i, j in itertools.combinations(range(60), 2)):
        if w <= limit and root(i) != root(j):
            parent[root(j)] = root(i)
            total.append(w)
    edges = similarity.forest_edges(df, limit, block_rows=25)
    got = [r["d"] for r in graph.spanning_forest(edges, small_edges=small).collect()]
    assert sorted(got) == pytest.approx(sorted(total))


def test_sweep_equals_single_runs(spark):
    df, m = points(spark, 80, seed=7)
    grid = [0.005, 0.02, 0.05]
    rows = cluster.eps_sweep(df, grid).collect()
    for eps in grid:
        assert {r["id"]: r["cluster_label"] for r in rows if r["eps"] == eps} == brute_labels(m, eps)


@pytest.mark.parametrize("block_rows", [8192, 13])
def test_top_matches_and_neighbours(spark, block_rows):
    df, m = points(spark, 50, seed=9)
    s = np.round(m @ m.T, 9)
    got = {}
    for r in blocks.top_matches(df, df, 3, block_rows=block_rows, exclude_same=True).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["match"]))
    for i in range(50):
        order = sorted((j for j in range(50) if j != i), key=lambda j: (-s[i, j], j))[:3]
        assert [x for _, x in sorted(got[i])] == order
    near = {r["id"]: r["neighbours"] for r in similarity.neighbour_counts(
        df, 0.05, block_rows=block_rows).collect()}
    d = np.round(1 - m @ m.T, 9)
    assert near == {i: int((d[i] <= 0.05).sum()) - 1 for i in range(50)}


def test_silhouette_against_pairs(spark):
    df, m = points(spark, 60, seed=11)
    label = {i: i % 4 if i < 50 else -1 for i in range(60)}
    labels = spark.createDataFrame(list(label.items()), "id bigint, cluster_label bigint")
    d = 1 - m @ m.T
    keep = [i for i in range(60) if label[i] != -1]
    values = []
    for i in keep:
        mean = {c: np.mean([d[i, j] for j in keep if label[j] == c and j != i]) for c in range(4)}
        a, b = mean[label[i]], min(v for c, v in mean.items() if c != label[i])
        values.append((b - a) / max(a, b))
    row = cluster.silhouette_cosine(df, labels).first()
    assert row["silhouette"] == pytest.approx(np.mean(values), abs=1e-9)
    assert cluster.silhouette_cosine(df, labels.withColumn("cluster_label", F.lit(0))).first()[
        "silhouette"] == 0.0


def test_numbering_of_large_tables(spark):
    rows = [(k, i) for k in ("a", "b", "c") for i in range(40 if k == "b" else 7)]
    df = spark.createDataFrame(rows, "k string, i bigint").repartition(5)
    index = skew.global_index(df, ["k", "i"], small_rows=0).orderBy("idx").collect()
    assert [(r["k"], r["i"]) for r in index] == sorted(rows)
    assert [r["idx"] for r in index] == list(range(len(rows)))
    pos = skew.number_in_group(df, ["k"], ["i"], small_rows=0, hot_rows=10)
    assert all(r["pos"] == r["i"] for r in pos.collect())
    parts = skew.in_parts(df, ["k"], ["i"], ["i"], part_rows=16, small_rows=0).collect()
    assert sorted((r["k"], r["part"], len(r["i"])) for r in parts) == [
        ("a", 0, 7), ("b", 0, 16), ("b", 1, 16), ("b", 2, 8), ("c", 0, 7)]


def test_lookup_join_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("y", 2)],
                                 "k string, v int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    lookup = counts.filter("k <> 'y'")
    for how, size in (("inner", 51), ("left", 52)):
        got = skew.lookup_join(rows, lookup, ["k"], how, counted="n", hot_rows=10)
        assert got.count() == size
        assert got.filter("k = 'hot' and n = 50").count() == 50
