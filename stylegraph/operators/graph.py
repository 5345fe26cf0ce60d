"""Components and spanning forests of large edge tables.

Both run as rounds of grouping and joining, each round written to the shared folder;
a spanning forest of few edges (by a checked count) is finished in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.operators.blocks import arrow_schema
from stylegraph.operators.skew import HOT_ROWS, lookup_join
from stylegraph.sources.staging import settle

# Edges a single task may finish alone.
SMALL_EDGES = 200_000


def connected_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Components of ``edges(*keys, a, b)`` as ``(*keys, node, component)``.

    A component is named by its smallest node. Graphs under different ``keys``
    are independent and solved together. Each round points every node of the contracted
    graph at its smallest neighbour, follows that pointer twice and keeps the edges between
    different targets; a round's tables are written, so joins can be split or broadcast by
    their real sizes.
    """
    keys = list(keys or [])

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
                            ).filter("a < b").distinct()

    def target(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select(*keys, F.col("node").alias(name), F.col("to").alias("_to"))

    links = settle(ordered(edges), "links")
    labels = settle(links.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
                    .withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        near = settle(links.groupBy(*keys, F.col("b").alias("node")).agg(F.min("a").alias("to")), "near")
        onward = near.select(*keys, F.col("node").alias("to"), F.col("to").alias("_far"))
        far = settle(near.join(onward, [*keys, "to"], "left").select(
            *keys, "node", F.coalesce("_far", "to").alias("to")), "far")
        labels = settle(labels.join(target(far, "component"), [*keys, "component"], "left").select(
            *keys, "node", F.coalesce("_to", "component").alias("component")), "labels")
        moved = links
        for end in ("a", "b"):
            moved = moved.join(target(far, end), [*keys, end], "left").withColumn(
                end, F.coalesce("_to", end)).drop("_to")
        links = settle(ordered(moved), "links")
    return labels


def spanning_forest(edges: DataFrame, small_edges: int = SMALL_EDGES,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Minimum spanning forest of ``edges(a, b, d)``, ties by ``(d, a, b)``."""
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
                   .filter("a <> b").groupBy("a", "b").agg(F.min("d").alias("d")), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, d double"
    if edges.count() <= small_edges:
        out = arrow_schema(schema)

        def solve(table: pa.Table) -> pa.Table:
            table = table.select(["a", "b", "d"]).sort_by(
                [("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
            a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
            parent: dict = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = root(x), root(y)
                if x != y:
                    parent[x] = y
                    keep.append(i)
            return table.take(pa.array(keep, pa.int64())).cast(out)

        return edges.withColumn("_k", F.lit(0)).groupBy("_k").applyInArrow(solve, schema)

    rest = edges.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    chosen = []
    while not rest.isEmpty():
        edge = F.struct("d", "a", "b", "ca", "cb")
        best = (rest.select(F.col("ca").alias("c"), edge.alias("e"))
                .unionByName(rest.select(F.col("cb").alias("c"), edge.alias("e")))
                .groupBy("c").agg(F.min("e").alias("e")))
        picks = settle(best.select("e.*").distinct(), "picks")
        chosen.append(picks.select("a", "b", "d"))
        merged = connected_components(picks.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        merged = settle(merged, "merged")
        for side in ("ca", "cb"):
            renamed = merged.select(F.col("node").alias(side), F.col("component").alias("_c"))
            rest = lookup_join(rest, renamed, [side], "left").withColumn(
                side, F.coalesce("_c", side)).drop("_c")
        # only the cheapest edge between two components can still matter
        slim = (rest.filter("ca <> cb")
                .withColumn("x", F.least("ca", "cb")).withColumn("y", F.greatest("ca", "cb"))
                .groupBy("x", "y").agg(F.min(F.struct("d", "a", "b")).alias("e")))
        rest = settle(slim.select("e.a", "e.b", "e.d", F.col("x").alias("ca"),
                                  F.col("y").alias("cb")), "edges")
    forest = chosen[0]
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    return forest


def grow_forest(n: int, distances, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest over ``n`` points of one block, edges up to ``limit``.

    ``distances(i)`` gives the distances of point ``i`` to all points.
    """
    best = np.full(n, np.inf)
    via = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)
    a, b, d = [], [], []
    for _ in range(n):
        cost = np.where(open_, best, np.inf)
        i = int(np.argmin(cost))
        if cost[i] <= limit:
            a.append(via[i])
            b.append(i)
            d.append(cost[i])
        else:
            i = int(np.argmax(open_))      # start another tree
        open_[i] = False
        row = distances(i)
        closer = open_ & (row < best)
        best[closer] = row[closer]
        via[closer] = i
    return np.array(a, int), np.array(b, int), np.array(d, float)
