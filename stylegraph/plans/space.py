"""Building the interpretable space, with a fixed or a searched threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylegraph.operators import cluster, metrics, sweep, tfidf
from stylegraph.plans import explain
from stylegraph.sources.staging import settle


def sweep_performance(docs: DataFrame, grid: list[float],
                      test: DataFrame | None = None) -> DataFrame:
    """Retrieval quality per threshold.

    ``docs(author_id, document_id, embedding)``; ``test`` defaults to the same
    documents. One row ``(eps, eer, ap, ndcg, mean_sim, bases)`` per threshold.
    The distances are computed once for all thresholds, documents are projected on narrow
    bases of all thresholds at once, and one job ranks them in every space.
    """
    means = settle(cluster.author_means(docs), "means")
    points = cluster.unit_points(means, "author_id")
    labels = settle(cluster.eps_sweep(points, grid).withColumnRenamed("id", "author_id"), "sweep")
    centroids = settle(cluster.centroids(means, labels, ["eps"]), "centroids")
    counted = centroids.groupBy("eps").agg(F.count(F.lit(1)).alias("bases"))
    tested = settle((test if test is not None else docs).select(
        F.col("document_id").alias("id"), "author_id",
        F.col("embedding").cast("array<double>").alias("vector")), "tested")
    # the place of the threshold above, the place of the basis below: in order of both
    steps = F.array(*[F.lit(float(e)) for e in grid])
    narrow = explain.narrow_bases(centroids.select(
        F.array_position(steps, F.col("eps")).alias("space"), F.col("cluster_label").alias("id"), F.col("centroid").alias("vector")))
    bases = narrow.select((F.shiftleft("space", 40) + F.col("id")).alias("id"), "vector")
    inner = explain.interpretable_vectors(tested.select("id", "vector"), bases)
    cells = F.filter(F.arrays_zip("labels", "scores"), lambda c: F.shiftright(c["labels"], 40) == F.col("place"))
    inner = inner.select("id", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("place"), "labels", "scores").select(
        "id", F.element_at(steps, F.col("place")).alias("space"), F.transform(cells, lambda c: c["scores"]).alias("vector"))
    ranked = inner.join(tested.select("id", "author_id"), "id")
    quality = metrics.sweep_metrics(ranked).withColumnRenamed("space", "eps")
    return settle(quality.join(counted, "eps"), "performance")


def build_space(docs: DataFrame, assignments: DataFrame, eps: float | None = None,
                grid: list[float] | None = None, top_k: int = 5, generate=None) -> dict[str, DataFrame]:
    """Clustered authors and documents, centroids, feature weights and a summary of each cluster.

    ``docs(author_id, document_id, embedding)`` and ``assignments(document_id,
    feature)``. Without ``eps`` the best threshold of ``grid`` is taken. Summaries join the
    ``top_k`` heaviest features; a text generator makes a paragraph of them.
    """
    means = settle(cluster.author_means(docs), "means")
    if eps is None:
        steps = grid or [round(0.01 * i, 2) for i in range(1, 100)]
        eps = sweep.best_eps(sweep_performance(docs, steps)).first()["eps"]
    points = cluster.unit_points(means, "author_id")
    labels = settle(cluster.dbscan(points, eps).withColumnRenamed("id", "author_id"), "labels")
    clustered = tfidf.attach_cluster(docs.select("author_id", "document_id"), labels)
    counts = tfidf.cluster_style_counts(assignments, clustered)
    weights = settle(tfidf.cluster_tfidf(counts, tfidf.feature_idf(assignments)), "weights")
    return {
        "documents": clustered,
        "authors": labels,
        "centroids": cluster.centroids(means, labels),
        "weights": weights,
        "summaries": explain.cluster_texts(weights, top_k, generate),
    }
