"""Density clusters of vectors at one threshold or over a sweep of thresholds.

With two points enough for a core point, density clusters are the connected
components of the "closer than eps" graph, and a minimum spanning forest of the
distances answers every eps at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylegraph.functions.vectors import dot, l2_normalize, vector_mean, vector_sum
from stylegraph.operators import blocks
from stylegraph.operators.graph import connected_components, spanning_forest
from stylegraph.operators.similarity import Distance, cosine_distance, forest_edges
from stylegraph.operators.skew import global_index, lookup_join, number_in_group
from stylegraph.sources.staging import settle

NOISE = -1


def author_means(docs: DataFrame, author: str = "author_id",
                 embedding: str = "embedding") -> DataFrame:
    """One mean vector per author: ``(author_id, vector)``."""
    vector = F.col(embedding).cast("array<double>")
    return docs.groupBy(F.col(author).alias("author_id")).agg(vector_mean(vector).alias("vector"))


def unit_points(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), l2_normalize(F.col("vector")).alias("vector"))


def _label(nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Number components by their smallest member; nodes without one are noise."""
    members = settle(members, "members")
    heads = settle(members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")), "heads")
    numbered = number_in_group(heads, keys, ["component"], "cluster_label") if keys else \
        global_index(heads, ["component"], "cluster_label")
    labelled = lookup_join(members, numbered, [*keys, "component"], counted="_n")
    labelled = labelled.select(*keys, F.col("node").alias("id"), "cluster_label")
    return (nodes.join(labelled, [*keys, "id"], "left")
            .withColumn("cluster_label",
                        F.coalesce(F.col("cluster_label"), F.lit(NOISE)).cast("bigint")))


def dbscan(points: DataFrame, eps: float, distance: Distance = cosine_distance,
           block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Labels ``(id, cluster_label)`` of ``points(id, vector)``; -1 is noise."""
    points = settle(points.select("id", "vector"), "points")
    return labels_of(points, forest_edges(points, eps, distance, block_rows))


def labels_of(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels ``(id, cluster_label)`` of the components of ``edges(a, b)``; -1 is noise."""
    return _label(points.select("id"), connected_components(edges), [])


def distance_forest(points: DataFrame, limit: float,
                    distance: Distance = cosine_distance) -> DataFrame:
    """Minimum spanning forest ``(a, b, d)`` of all distances up to ``limit``."""
    return spanning_forest(forest_edges(points, limit, distance))


def eps_sweep(points: DataFrame, grid: list[float],
              distance: Distance = cosine_distance) -> DataFrame:
    """Labels for every threshold: ``(eps, id, cluster_label)``."""
    forest = distance_forest(points, max(grid), distance)
    steps = F.array(*[F.lit(float(e)) for e in grid])
    edges = forest.select(
        F.explode(F.filter(steps, lambda e: e >= F.col("d"))).alias("eps"), "a", "b")
    members = connected_components(edges, ["eps"])
    nodes = points.select(F.explode(steps).alias("eps"), "id")
    return _label(nodes, members, ["eps"])


def drop_noise(rows: DataFrame, label: str = "cluster_label") -> DataFrame:
    return rows.filter(F.col(label) != NOISE)


def centroids(vectors: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean author vector per cluster, noise included as cluster -1."""
    keys = list(keys or [])
    joined = vectors.join(labels, "author_id")
    return joined.groupBy(*keys, "cluster_label").agg(
        vector_mean(F.col("vector")).alias("centroid"), F.count(F.lit(1)).alias("authors"))


def silhouette_cosine(points: DataFrame, labels: DataFrame, keep_noise: bool = False) -> DataFrame:
    """Mean cosine silhouette as one row ``(clusters, points, silhouette)``.

    The mean distance to a cluster is one minus the dot product with the mean of
    its unit vectors, so no pair of points is formed. It is 0 unless there are
    more than one and fewer than ``points`` clusters.
    """
    rows = points.join(labels, "id")
    if not keep_noise:
        rows = drop_noise(rows)
    rows = settle(rows.select("id", "vector", "cluster_label"), "clustered")
    means = settle(rows.groupBy("cluster_label").agg(
        vector_mean(F.col("vector")).alias("mean"), F.count(F.lit(1)).alias("n")), "means")
    near = blocks.top_matches(
        rows.select("id", "vector"),
        means.select(F.col("cluster_label").alias("id"), F.col("mean").alias("vector")), 2)
    own = lookup_join(rows, means, ["cluster_label"], counted="n").select(
        "id", "cluster_label", "n", dot(F.col("vector"), F.col("mean")).alias("own"))
    other = (near.join(own.select("id", "cluster_label"), "id")
             .filter("match <> cluster_label")
             .groupBy("id").agg(F.max("score").alias("best")))
    inside = F.try_divide((1.0 - F.col("own")) * F.col("n"), F.col("n") - 1)
    outside = 1.0 - F.col("best")
    scored = own.join(other, "id", "left").select(
        "cluster_label",
        F.when((F.col("n") > 1) & F.col("best").isNotNull(),
               F.try_divide(outside - inside, F.greatest(inside, outside))).otherwise(0.0)
        .alias("s"))
    summary = scored.groupBy("cluster_label").agg(
        F.sum(F.coalesce("s", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"),
        F.sum("s").alias("s"))
    usable = (F.col("clusters") > 1) & (F.col("clusters") < F.col("points"))
    return summary.select("clusters", "points", F.when(
        usable, F.try_divide("s", "points")).otherwise(0.0).alias("silhouette"))


def small_clusters(members: DataFrame, label: str = "cluster_label", below: int = 10) -> DataFrame:
    """Members of clusters with fewer than ``below`` members."""
    sizes = members.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < below)
    return members.join(sizes.select(label), label, "left_semi")


def sample_per_group(members: DataFrame, label: str, key: str, n: int = 5,
                     seed: str = "0") -> DataFrame:
    """Up to ``n`` members per group, picked by a seeded hash."""
    from pyspark.sql import Window

    draw = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    w = Window.partitionBy(label).orderBy(draw, F.col(key))
    return (members.withColumn("draw", F.row_number().over(w).cast("bigint"))
            .filter(F.col("draw") <= n))
