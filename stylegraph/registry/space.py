"""Queries over vectors, clusters, feature weights and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylegraph.functions import vectors as V
from stylegraph.operators import cluster, metrics, similarity, tfidf
from stylegraph.operators.blocks import top_matches
from stylegraph.plans import explain
from stylegraph.registry.base import CTE, Tables, query, r6, with_
from stylegraph.sources.staging import settle

EPS = 0.80
NEAR = 0.64          # among the authors of four vectors each
GRID = [round(0.60 + 0.02 * i, 2) for i in range(13)]


def means_cte(view: str, name: str = "means") -> str:
    return f"""{name} AS (SELECT author_id, list(v ORDER BY pos) AS vector FROM (
        SELECT author_id, pos, avg(x) AS v FROM (SELECT author_id, unnest(embedding) AS x,
               unnest(generate_series(1, len(embedding))) AS pos FROM {view})
        GROUP BY author_id, pos) GROUP BY author_id)"""


PAIRS = """pairs AS (SELECT a.author_id AS a, b.author_id AS b,
        round(1 - list_cosine_similarity(a.vector, b.vector), 9) AS d
        FROM means a JOIN means b ON a.author_id < b.author_id)"""


def labels_cte(eps: float) -> str:
    return f"""edges AS (SELECT a, b FROM pairs WHERE d <= {eps}
        UNION ALL SELECT b, a FROM pairs WHERE d <= {eps}),
        reach AS (SELECT author_id AS node, author_id AS root FROM means
        UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
        comp AS (SELECT node, min(root) AS component, count(*) AS members FROM reach GROUP BY node),
        heads AS (SELECT component, dense_rank() OVER (ORDER BY component) - 1 AS label
        FROM (SELECT DISTINCT component FROM comp WHERE members > 1)),
        labels AS (SELECT c.node AS author_id,
        coalesce(CASE WHEN c.members > 1 THEN h.label END, -1)::BIGINT AS cluster_label
        FROM comp c LEFT JOIN heads h ON h.component = c.component)"""


CENTROIDS = """centroids AS (SELECT cluster_label, list(v ORDER BY pos) AS centroid,
        any_value(n) AS authors FROM (
        SELECT cluster_label, pos, avg(x) AS v, count(*) AS n FROM (
        SELECT l.cluster_label, unnest(m.vector) AS x,
               unnest(generate_series(1, len(m.vector))) AS pos
        FROM means m JOIN labels l ON l.author_id = m.author_id)
        GROUP BY cluster_label, pos) GROUP BY cluster_label)"""
IDF = """idf AS (SELECT feature, count(*) AS "rows",
        ln((SELECT count(DISTINCT document_id) FROM assignments) / count(*)) AS idf
        FROM assignments GROUP BY feature)"""
COUNTS = """counts AS (SELECT l.cluster_label, s.feature, count(*) AS n
        FROM docs d JOIN labels l ON l.author_id = d.author_id
        JOIN assignments s ON s.document_id = d.document_id GROUP BY 1, 2)"""
WEIGHTS = """weights AS (SELECT c.cluster_label, c.feature,
        coalesce(c.n * i.idf, 0) AS weight FROM counts c LEFT JOIN idf i ON i.feature = c.feature)"""


def space_sql(*more: str, eps: float = EPS, view: str = "docs") -> str:
    """WITH clause of the interpretable space, and further definitions."""
    views = ["docs"] if view == "docs" else [view]
    base = ",\n".join([means_cte(view), PAIRS, labels_cte(eps), CENTROIDS, *more])
    return with_(*views, "assignments", extra=base, recursive=True)


def author_labels(t: Tables, eps: float = EPS, docs=None):
    """Author means and their clusters."""
    means = settle(cluster.author_means(docs if docs is not None else t.docs), "means")
    points = cluster.unit_points(means, "author_id")
    labels = settle(cluster.dbscan(points, eps).withColumnRenamed("id", "author_id"), "labels")
    return means, labels


def space_centroids(t: Tables):
    means, labels = author_labels(t)
    return means, labels, settle(cluster.centroids(means, labels), "centroids")


def space(t: Tables):
    means, labels, centroids = space_centroids(t)
    docs = tfidf.attach_cluster(t.docs.select("document_id", "author_id"), labels)
    styles = style_table(t)
    weights = tfidf.cluster_tfidf(tfidf.cluster_style_counts(styles, docs),
                                  tfidf.feature_idf(styles))
    return means, labels, centroids, weights


def style_table(t: Tables):
    """The style assignments as a table, for jobs that read them several times."""
    return settle(t.assignments.select("document_id", "feature"), "styles")


def unit_docs(docs):
    """Documents as ``(id, vector)`` with the raw embedding."""
    return docs.select(F.col("document_id").alias("id"), F.col("embedding").alias("vector"))


# --- vectors ---------------------------------------------------------------

@query("cosine", with_("docs", extra=means_cte("docs")) + """
    SELECT d.document_id, round(list_cosine_similarity(d.embedding, m.vector), 6) + 0.0 AS similarity,
           round(1 - list_cosine_similarity(d.embedding, m.vector), 6) + 0.0 AS distance
    FROM docs d JOIN means m ON m.author_id = d.author_id""")
def _cosine(t: Tables):
    means = cluster.author_means(t.docs)
    c = V.cosine(F.col("embedding"), F.col("vector"))
    return t.docs.join(means, "author_id").select(
        "document_id", r6(c, "similarity"), r6(1 - c, "distance"))


@query("dot", with_("docs", extra=means_cte("docs")) + """
    SELECT d.document_id, round(list_dot_product(d.embedding, m.vector), 6) + 0.0 AS component
    FROM docs d JOIN means m ON m.author_id = d.author_id""")
def _dot(t: Tables):
    means = cluster.author_means(t.docs)
    return t.docs.join(means, "author_id").select(
        "document_id", r6(V.dot(F.col("embedding"), F.col("vector")), "component"))


@query("l2_normalize", with_("docs", extra=means_cte("docs")) + """
    SELECT author_id, pos, round(x / sqrt(list_dot_product(vector, vector)), 6) + 0.0 AS x FROM (
    SELECT author_id, vector, unnest(vector) AS x,
           unnest(generate_series(0, len(vector) - 1)) AS pos FROM means)""")
def _l2_normalize(t: Tables):
    unit = cluster.author_means(t.docs).select(
        "author_id", F.posexplode(V.l2_normalize(F.col("vector"))).alias("pos", "x"))
    return unit.select("author_id", F.col("pos").cast("bigint").alias("pos"), r6("x", "x"))


@query("rescale_unit", with_("docs50") + """
    SELECT document_id, pos, round((x + 1) / 2, 6) + 0.0 AS x FROM (
    SELECT document_id, unnest(embedding) AS x,
           unnest(generate_series(0, len(embedding) - 1)) AS pos FROM docs50)""")
def _rescale_unit(t: Tables):
    rows = t.docs50.select("document_id", F.posexplode(
        V.rescale_unit(F.col("embedding"))).alias("pos", "x"))
    return rows.select("document_id", F.col("pos").cast("bigint").alias("pos"), r6("x", "x"))


_MEAN_ROWS = """ SELECT {key}, pos, round(x, 6) + 0.0 AS x FROM (
    SELECT {key}, unnest({vector}) AS x,
           unnest(generate_series(0, len({vector}) - 1)) AS pos FROM {table})"""


def _long(df, key: str, vector: str):
    rows = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), r6("x", "x"))


@query("author_mean_embedding", with_("docs", extra=means_cte("docs"))
       + _MEAN_ROWS.format(key="author_id", vector="vector", table="means"))
def _author_mean_embedding(t: Tables):
    return _long(cluster.author_means(t.docs), "author_id", "vector")


@query("vector_mean", with_("docs50", extra=means_cte("docs50"))
       + _MEAN_ROWS.format(key="author_id", vector="vector", table="means"))
def _vector_mean(t: Tables):
    means = t.docs50.groupBy("author_id").agg(V.vector_mean(F.col("embedding")).alias("vector"))
    return _long(means, "author_id", "vector")


# --- distances and clusters ------------------------------------------------

@query("pairwise_cosine_distance", with_("quads", extra=",\n".join([means_cte("quads"), PAIRS])) + """,
    near AS (SELECT a.author_id AS a, b.author_id AS b, 1 - list_cosine_similarity(a.vector, b.vector) AS d
        FROM means a JOIN means b ON a.author_id <> b.author_id)
    SELECT a AS author_id, rank, b AS neighbour, round(d, 6) + 0.0 AS distance FROM (
    SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rank FROM near)
    WHERE rank <= 5""")
def _pairwise_cosine_distance(t: Tables):
    points = settle(cluster.unit_points(cluster.author_means(t.quads), "author_id"), "points")
    near = top_matches(points, points, 5, exclude_same=True)
    return near.select(F.col("id").alias("author_id"), "rank", F.col("match").alias("neighbour"),
                       r6(1 - F.col("score"), "distance"))


@query("eps_neighbours", with_("quads", extra=",\n".join([means_cte("quads"), PAIRS])) + """,
    both_ways AS (SELECT a, b, d FROM pairs UNION ALL SELECT b, a, d FROM pairs)
    SELECT a AS author_id, count(*) FILTER (WHERE d <= {}) AS neighbours
    FROM both_ways GROUP BY a""".format(NEAR))
def _eps_neighbours(t: Tables):
    points = settle(cluster.unit_points(cluster.author_means(t.quads), "author_id"), "points")
    return similarity.neighbour_counts(points, NEAR).withColumnRenamed("id", "author_id")


@query("dbscan", space_sql(view="quads", eps=NEAR) + "SELECT author_id, cluster_label FROM labels")
def _dbscan(t: Tables):
    return author_labels(t, NEAR, t.quads)[1]


@query("drop_noise", space_sql() + """SELECT author_id, cluster_label FROM labels
    WHERE cluster_label <> -1""")
def _drop_noise(t: Tables):
    return cluster.drop_noise(author_labels(t)[1])


@query("cluster_centroids", space_sql()
       + _MEAN_ROWS.format(key="cluster_label", vector="centroid", table="centroids"))
def _cluster_centroids(t: Tables):
    means, labels = author_labels(t)
    return _long(cluster.centroids(means, labels), "cluster_label", "centroid")


_GRID_SQL = ", ".join(f"{e:.2f}" for e in GRID)
SWEEP = f"""grid AS (SELECT unnest([{_GRID_SQL}])::DOUBLE AS eps),
    walk AS (SELECT eps, author_id AS node, author_id AS root FROM means, grid
    UNION SELECT w.eps, e.b, w.root FROM walk w JOIN (
        SELECT a, b, d FROM pairs UNION ALL SELECT b, a, d FROM pairs) e
        ON e.a = w.node AND e.d <= w.eps),
    group_of AS (SELECT eps, node, min(root) AS component, count(*) AS members
        FROM walk GROUP BY eps, node),
    sweep AS (SELECT g.eps, g.node AS author_id, coalesce(h.label, -1)::BIGINT AS cluster_label
        FROM group_of g LEFT JOIN (SELECT eps, component,
            dense_rank() OVER (PARTITION BY eps ORDER BY component) - 1 AS label
            FROM (SELECT DISTINCT eps, component FROM group_of WHERE members > 1)) h
        ON h.eps = g.eps AND h.component = g.component)"""


@query("eps_sweep", with_("quads", recursive=True,
                          extra=",\n".join([means_cte("quads"), PAIRS, SWEEP]))
       + "SELECT eps, author_id, cluster_label FROM sweep")
def _eps_sweep(t: Tables):
    points = settle(cluster.unit_points(cluster.author_means(t.quads), "author_id"), "points")
    return cluster.eps_sweep(points, GRID).withColumnRenamed("id", "author_id")


@query("silhouette_cosine", space_sql(view="quads", eps=NEAR) + """,
    kept AS (SELECT m.author_id, m.vector, l.cluster_label FROM means m
        JOIN labels l ON l.author_id = m.author_id WHERE l.cluster_label <> -1),
    to_cluster AS (SELECT a.author_id, a.cluster_label AS own, b.cluster_label AS other,
        sum(CASE WHEN a.author_id = b.author_id THEN 0
            ELSE 1 - list_cosine_similarity(a.vector, b.vector) END) AS total, count(*) AS n
        FROM kept a JOIN kept b ON true GROUP BY 1, 2, 3),
    ab AS (SELECT author_id, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN own <> other THEN total / n END) AS b FROM to_cluster GROUP BY author_id)
    SELECT (SELECT count(DISTINCT cluster_label) FROM kept) AS clusters, count(*) AS points,
        round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""")
def _silhouette(t: Tables):
    means, labels = author_labels(t, NEAR, t.quads)
    points = cluster.unit_points(means, "author_id")
    got = cluster.silhouette_cosine(points, labels.withColumnRenamed("author_id", "id"))
    return got.select("clusters", "points", r6("silhouette", "silhouette"))


@query("small_clusters", space_sql(view="quads", eps=NEAR) + """
    SELECT author_id, cluster_label FROM labels WHERE cluster_label IN (
    SELECT cluster_label FROM labels GROUP BY 1 HAVING count(*) < 10)""")
def _small_clusters(t: Tables):
    return cluster.small_clusters(author_labels(t, NEAR, t.quads)[1]).select(
        "author_id", "cluster_label")


@query("sample_per_group", with_("docs") + """
    SELECT author_id, document_id, draw FROM (SELECT author_id, document_id, row_number() OVER (
        PARTITION BY author_id ORDER BY md5('7' || document_id::VARCHAR), document_id) AS draw
        FROM docs) WHERE draw <= 5""")
def _sample_per_group(t: Tables):
    rows = t.docs.select("author_id", "document_id")
    return cluster.sample_per_group(rows, "author_id", "document_id", 5, "7")


# --- feature weights ---------------------------------------------------------

@query("select_feature", with_("assignments") + "SELECT document_id, feature FROM assignments")
def _select_feature(t: Tables):
    styles = t.assignments.withColumnRenamed("feature", "final_attribute_name")
    return tfidf.select_feature(styles, "final_attribute_name")


@query("not_nan_features", with_("assignments") + """SELECT document_id, pos, feature
    FROM assignments WHERE feature IS NOT NULL AND feature <> 'nan'""")
def _not_nan(t: Tables):
    return tfidf.drop_nan(t.assignments).select("document_id", "pos", "feature")


@query("feature_idf", with_("assignments", extra=IDF) + """
    SELECT feature, "rows", round(idf, 6) + 0.0 AS idf FROM idf""")
def _feature_idf(t: Tables):
    return tfidf.feature_idf(t.assignments).select("feature", "rows", r6("idf", "idf"))


@query("attach_cluster", space_sql() + """SELECT d.document_id, d.author_id, l.cluster_label
    FROM docs d JOIN labels l ON l.author_id = d.author_id""")
def _attach_cluster(t: Tables):
    docs = t.docs.select("document_id", "author_id")
    return tfidf.attach_cluster(docs, author_labels(t)[1]).select(
        "document_id", "author_id", "cluster_label")


def clustered_docs(t: Tables):
    return tfidf.attach_cluster(t.docs.select("document_id", "author_id"), author_labels(t)[1])


@query("cluster_style_counts", space_sql(COUNTS) + "SELECT cluster_label, feature, n FROM counts")
def _cluster_style_counts(t: Tables):
    return tfidf.cluster_style_counts(t.assignments, clustered_docs(t))


@query("cluster_tfidf", space_sql(IDF, COUNTS, WEIGHTS) + """
    SELECT cluster_label, feature, round(weight, 6) + 0.0 AS weight FROM weights""")
def _cluster_tfidf(t: Tables):
    styles = style_table(t)
    counts = tfidf.cluster_style_counts(styles, clustered_docs(t))
    return tfidf.cluster_tfidf(counts, tfidf.feature_idf(styles)).select(
        "cluster_label", "feature", r6("weight", "weight"))


@query("cluster_tfidf_log", space_sql(IDF, COUNTS) + """
    SELECT c.cluster_label, c.feature, round(ln(1 + c.n) * i.idf, 6) + 0.0 AS weight
    FROM counts c JOIN idf i ON i.feature = c.feature""")
def _cluster_tfidf_log(t: Tables):
    styles = style_table(t)
    counts = tfidf.cluster_style_counts(styles, clustered_docs(t))
    return tfidf.cluster_tfidf(counts, tfidf.feature_idf(styles), log_counts=True).select(
        "cluster_label", "feature", r6("weight", "weight"))


@query("cluster_tfidf_matrix", space_sql(IDF, COUNTS, WEIGHTS) + """,
    vocabulary AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_index FROM idf)
    SELECT w.cluster_label, v.feature_index, round(w.weight, 6) + 0.0 AS weight
    FROM weights w JOIN vocabulary v ON v.feature = w.feature""")
def _cluster_tfidf_matrix(t: Tables):
    styles = style_table(t)
    idf = settle(tfidf.feature_idf(styles), "idf")
    counts = tfidf.cluster_style_counts(styles, clustered_docs(t))
    cells = tfidf.cluster_tfidf_matrix(tfidf.cluster_tfidf(counts, idf), idf)
    return cells.select("cluster_label", "feature_index", r6("weight", "weight"))


@query("doc_feature_matrix", with_("assignments") + """,
    vocabulary AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_index
        FROM (SELECT DISTINCT feature FROM assignments)),
    ones AS (SELECT DISTINCT a.document_id, v.feature_index FROM assignments a
        JOIN vocabulary v ON v.feature = a.feature)
    SELECT e.vec_id AS document_id, o.feature_index,
        (CASE WHEN o.feature_index IS NULL THEN 0 ELSE 1 END)::BIGINT AS value
    FROM embeddings e LEFT JOIN ones o ON o.document_id = e.vec_id""")
def _doc_feature_matrix(t: Tables):
    return tfidf.doc_feature_matrix(
        t.assignments.select("document_id", "feature"),
        t.embeddings.select(F.col("vec_id").alias("document_id")))


@query("top_features", space_sql(IDF, COUNTS, WEIGHTS) + """
    SELECT cluster_label, feature_rank, feature, round(weight, 6) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY weight DESC, feature) AS feature_rank
    FROM weights WHERE weight > 0) WHERE feature_rank <= 5""")
def _top_features(t: Tables):
    return tfidf.top_features(space(t)[3], 5).select(
        "cluster_label", "feature_rank", "feature", r6("weight", "weight"))


@query("top_features_tfidf", space_sql(IDF, COUNTS, WEIGHTS) + """
    SELECT cluster_label, feature_rank, feature, round(weight, 6) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY weight DESC, feature) AS feature_rank
    FROM weights) WHERE feature_rank <= 10 AND feature <> 'nan'""")
def _top_features_tfidf(t: Tables):
    return tfidf.top_features_tfidf(space(t)[3], 10).select(
        "cluster_label", "feature_rank", "feature", r6("weight", "weight"))


@query("tfidf_representation", space_sql(IDF, COUNTS) + """
    SELECT cluster_label, feature_rank, feature, round(weight, 6) AS weight FROM (
    SELECT c.cluster_label, c.feature, ln(1 + c.n) * i.idf AS weight, row_number() OVER (
        PARTITION BY c.cluster_label ORDER BY ln(1 + c.n) * i.idf DESC, c.feature) AS feature_rank
    FROM counts c JOIN idf i ON i.feature = c.feature WHERE c.cluster_label <> -1)
    WHERE feature_rank <= 5 AND feature <> 'nan'""")
def _tfidf_representation(t: Tables):
    return tfidf.tfidf_representation(style_table(t), clustered_docs(t), 5).select(
        "cluster_label", "feature_rank", "feature", r6("weight", "weight"))


@query("topn_by_weight", with_("assignments") + """
    SELECT document_id, feature_rank, feature, weight FROM (
    SELECT document_id, feature, count(*)::DOUBLE AS weight, row_number() OVER (
        PARTITION BY document_id ORDER BY count(*) DESC, feature) AS feature_rank
    FROM assignments GROUP BY document_id, feature)""")
def _topn_by_weight(t: Tables):
    counts = t.assignments.groupBy("document_id", "feature").agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    maps = counts.groupBy("document_id").agg(F.map_from_entries(
        F.collect_list(F.struct("feature", "w"))).alias("m"))
    ranked = maps.select("document_id", F.posexplode(tfidf.topn_by_weight(F.col("m"))).alias("i", "e"))
    return ranked.select("document_id", (F.col("i") + 1).cast("bigint").alias("feature_rank"),
                         "e.feature", "e.weight")


@query("doc_feature_lists", with_("assignments") + """
    SELECT document_id, list(feature ORDER BY pos) AS features FROM assignments GROUP BY document_id""")
def _doc_feature_lists(t: Tables):
    return tfidf.doc_feature_lists(t.assignments)


@query("attach_doc_styles", with_("assignments") + """
    SELECT d.doc_id AS document_id, coalesce(l.features, []) AS features FROM documents d
    LEFT JOIN (SELECT document_id, list(feature ORDER BY pos) AS features
        FROM assignments GROUP BY document_id) l ON l.document_id = d.doc_id""")
def _attach_doc_styles(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("document_id"))
    return tfidf.attach_doc_styles(docs, tfidf.doc_feature_lists(t.assignments))


@query("author_features", with_("docs", "assignments") + """
    SELECT d.author_id, d.document_id, s.pos, s.feature
    FROM docs d JOIN assignments s ON s.document_id = d.document_id""")
def _author_features(t: Tables):
    return tfidf.author_features(t.docs, t.assignments).select(
        "author_id", "document_id", "pos", "feature")


@query("cluster_documents_list", space_sql() + """
    SELECT l.cluster_label, d.document_id FROM docs d JOIN labels l ON l.author_id = d.author_id""")
def _cluster_documents_list(t: Tables):
    return tfidf.cluster_documents(clustered_docs(t))


@query("docs_with_styles", with_("assignments") + """
    SELECT doc_id AS document_id FROM documents
    WHERE doc_id IN (SELECT document_id FROM assignments)""")
def _docs_with_styles(t: Tables):
    return tfidf.docs_with_styles(
        t.documents.select(F.col("doc_id").alias("document_id")), t.assignments)


@query("cluster_feature_set", space_sql(COUNTS) + "SELECT DISTINCT cluster_label, feature FROM counts")
def _cluster_feature_set(t: Tables):
    return tfidf.cluster_feature_set(t.assignments, clustered_docs(t))


@query("feature_vocabulary", with_("docs", "assignments") + """
    SELECT DISTINCT s.feature FROM docs d JOIN assignments s ON s.document_id = d.document_id""")
def _feature_vocabulary(t: Tables):
    return tfidf.feature_vocabulary(space(t)[3])


# --- explanations --------------------------------------------------------------

BASES = """bases AS (SELECT cluster_label, list_transform(centroid,
        lambda x: x / sqrt(list_dot_product(centroid, centroid))) AS base
        FROM centroids WHERE cluster_label <> -1)"""
SCORES = """scores AS (SELECT d.document_id, b.cluster_label,
        list_dot_product(d.embedding, b.base) AS score FROM docs d, bases b)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id
        ORDER BY round(score, 9) DESC, cluster_label) AS rank FROM scores)"""


@query("interpretable_vectors", space_sql(BASES) + """
    SELECT d.document_id, b.cluster_label, round(list_dot_product(d.embedding, b.base), 6) + 0.0 AS score
    FROM docs d, bases b""")
def _interpretable_vectors(t: Tables):
    centroids = space_centroids(t)[2]
    rows = explain.score_rows(explain.interpretable_vectors(
        unit_docs(t.docs), explain.directions(centroids)))
    return rows.select(F.col("id").alias("document_id"), "cluster_label", r6("score", "score"))


@query("rank_clusters", space_sql(BASES, SCORES, RANKED) + """
    SELECT document_id, rank, cluster_label, round(score, 6) + 0.0 AS score FROM ranked""")
def _rank_clusters(t: Tables):
    bases = explain.directions(space_centroids(t)[2])
    return explain.rank_clusters(unit_docs(t.docs), bases, bases.count()).select(
        "document_id", "rank", "cluster_label", r6("score", "score"))


TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label
        ORDER BY weight DESC, feature) AS feature_rank FROM weights WHERE cluster_label <> -1)
        WHERE feature_rank <= 5)"""
_EXPLAINED = """SELECT r.document_id, r.rank, r.cluster_label, t.feature_rank, t.feature,
    round(t.weight, 6) + 0.0 AS weight FROM ranked r JOIN top t ON t.cluster_label = r.cluster_label
    WHERE r.rank <= {c}"""


def explained(t: Tables, top_c: int, reverse: bool = False):
    _, _, centroids, weights = space(t)
    rows = explain.explain_documents(unit_docs(t.docs), centroids, weights, top_c, 5, reverse)
    return rows.select("document_id", "rank", "cluster_label", "feature_rank", "feature",
                       r6("weight", "weight"))


@query("explain_documents", space_sql(IDF, COUNTS, WEIGHTS, BASES, SCORES, RANKED, TOP)
       + _EXPLAINED.format(c=3))
def _explain_documents(t: Tables):
    return explained(t, 3)


@query("top_cluster_features", space_sql(IDF, COUNTS, WEIGHTS, BASES, SCORES, RANKED, TOP)
       + _EXPLAINED.format(c=1))
def _top_cluster_features(t: Tables):
    return explained(t, 1)


@query("least_similar_clusters", space_sql(
    IDF, COUNTS, WEIGHTS, BASES, SCORES,
    RANKED.replace("9) DESC", "9) ASC"), TOP) + _EXPLAINED.format(c=2))
def _least_similar_clusters(t: Tables):
    return explained(t, 2, reverse=True)


@query("describe_documents", space_sql(IDF, COUNTS, WEIGHTS, BASES, SCORES, RANKED, TOP) + """
    SELECT r.document_id, r.rank, r.cluster_label, round(r.score, 6) + 0.0 AS score,
        t.feature_rank, t.feature FROM ranked r JOIN top t ON t.cluster_label = r.cluster_label
    WHERE r.rank <= 2""")
def _describe_documents(t: Tables):
    _, _, centroids, weights = space(t)
    rows = explain.explain_documents(unit_docs(t.docs), centroids, weights, 2, 5)
    return rows.select("document_id", "rank", "cluster_label", r6("score", "score"),
                       "feature_rank", "feature")


TEXTS = """texts AS (SELECT cluster_label, list(feature ORDER BY feature_rank) AS features,
        string_agg(feature, ' - ' ORDER BY feature_rank) AS summary FROM top GROUP BY cluster_label)"""


@query("build_interpretable_space", space_sql(IDF, COUNTS, WEIGHTS, TOP, TEXTS) + """
    SELECT w.cluster_label, c.authors, w.feature, round(w.weight, 6) + 0.0 AS weight,
        round(sqrt(list_dot_product(c.centroid, c.centroid)), 6) AS centroid_norm, t.summary
    FROM weights w JOIN centroids c ON c.cluster_label = w.cluster_label LEFT JOIN texts t ON t.cluster_label = w.cluster_label""")
def _build_space(t: Tables):
    _, _, centroids, weights = space(t)
    weights = settle(weights, "weights")
    size = centroids.select("cluster_label", "authors", r6(V.norm(F.col("centroid")), "centroid_norm"))
    size = size.join(explain.cluster_texts(weights).select("cluster_label", "summary"), "cluster_label", "left")
    return weights.join(size, "cluster_label").select(
        "cluster_label", "authors", "feature", r6("weight", "weight"), "centroid_norm", "summary")


#: Candidates explained per query and space: the report is a top-k list, ranks count all candidates.
BEST = 10
INTERP = """interp AS (SELECT document_id, list(score ORDER BY cluster_label) AS v FROM (
        SELECT d.document_id, b.cluster_label, list_dot_product(d.embedding, b.base) AS score
        FROM docs d, bases b) GROUP BY document_id)"""
PLACED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY latent DESC, candidate_id) AS latent_rank,
        row_number() OVER (PARTITION BY query_id ORDER BY interp DESC, candidate_id) AS interp_rank FROM sims),
    matches AS (SELECT * FROM placed WHERE latent_rank <= {BEST} OR interp_rank <= {BEST})"""
PREDICTED = """both_spaces AS MATERIALIZED (SELECT d.document_id, d.embedding, x.v FROM docs d JOIN interp x USING (document_id)),
    sims AS (SELECT a.document_id AS query_id, b.document_id AS candidate_id,
        round(list_cosine_similarity(a.embedding, b.embedding), 9) AS latent,
        round(list_cosine_similarity(a.v, b.v), 9) AS interp
        FROM both_spaces a JOIN both_spaces b ON a.document_id % 20 = 0 AND a.document_id <> b.document_id),
    """ + PLACED


def asked(t: Tables):
    """Every document whose id is divisible by 20 is a query, all others are its candidates."""
    return t.docs.filter("document_id % 20 = 0").select(F.col("document_id").alias("query_id"))


@query("rank_candidates", space_sql(BASES, INTERP, PREDICTED) + """
    SELECT query_id, candidate_id, latent_rank, interp_rank FROM matches""")
def _rank_candidates(t: Tables):
    spaces = explain.two_spaces(unit_docs(t.docs), explain.directions(space_centroids(t)[2]))
    return explain.rank_candidates(spaces, asked(t), BEST).select(
        "query_id", "candidate_id", "latent_rank", "interp_rank")


_ON_QUERY = """SELECT m.query_id, m.candidate_id, m.latent_rank, m.interp_rank, r.rank, r.cluster_label,
    round(r.score, 6) + 0.0 AS query_score, round(s.score, 6) + 0.0 AS score FROM matches m
    JOIN ranked r ON r.document_id = m.query_id AND r.rank <= 2
    JOIN scores s ON s.document_id = m.candidate_id AND s.cluster_label = r.cluster_label"""


@query("scores_on_query_clusters", space_sql(BASES, SCORES, RANKED, INTERP, PREDICTED) + """
    SELECT query_id, candidate_id, rank, cluster_label, score FROM (""" + _ON_QUERY + ")")
def _scores_on_query_clusters(t: Tables):
    spaces = explain.two_spaces(unit_docs(t.docs), explain.directions(space_centroids(t)[2]))
    ranks = settle(explain.rank_candidates(spaces, asked(t), BEST).select("query_id", "candidate_id"), "ranks")
    clusters = spaces.select(F.explode("labels").alias("cluster_label")).distinct()
    return explain.explain_matches(ranks, spaces, clusters, 2).select(
        "query_id", "candidate_id", "rank", "cluster_label", r6("score", "score"))


@query("explain_prediction", space_sql(IDF, COUNTS, WEIGHTS, BASES, SCORES, RANKED, TOP, TEXTS, INTERP, PREDICTED) + """
    SELECT q.*, t.features, t.summary FROM (""" + _ON_QUERY + ") q LEFT JOIN texts t ON t.cluster_label = q.cluster_label")
def _explain_prediction(t: Tables):
    _, _, centroids, weights = space(t)
    rows = explain.explain_prediction(unit_docs(t.docs), asked(t), centroids, weights, top_c=2, candidates=BEST)
    return rows.select("query_id", "candidate_id", "latent_rank", "interp_rank", "rank", "cluster_label",
                       r6("query_score", "query_score"), r6("score", "score"), "features", "summary")


REPRESENTATIVE = """chosen AS (SELECT author_id, document_id, closeness FROM (
        SELECT d.author_id, d.document_id,
        round(list_cosine_similarity(d.embedding, m.vector), 9) AS closeness,
        row_number() OVER (PARTITION BY d.author_id ORDER BY
        round(list_cosine_similarity(d.embedding, m.vector), 9) DESC, d.document_id) AS place
        FROM docs d JOIN means m ON m.author_id = d.author_id) WHERE place = 1)"""


@query("representative_document", with_("docs", extra=",\n".join([means_cte("docs"), REPRESENTATIVE])) + """
    SELECT author_id, document_id, round(closeness, 6) AS closeness FROM chosen""")
def _representative(t: Tables):
    docs = t.docs.select("author_id", F.col("document_id").alias("id"),
                         F.col("embedding").alias("vector"))
    return explain.representative_document(docs).select(
        "author_id", "document_id", r6("closeness", "closeness"))


AUTHOR_SPACES = """unit AS MATERIALIZED (SELECT document_id, author_id, list_transform(embedding,
        lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM docs),
    inner_space AS (SELECT document_id, author_id, list(s ORDER BY cluster_label) AS v FROM (
        SELECT u.document_id, u.author_id, b.cluster_label, list_dot_product(u.v, b.base) AS s
        FROM unit u, bases b) GROUP BY 1, 2),
    latent_means AS (SELECT author_id, list(m ORDER BY pos) AS v FROM (SELECT author_id, pos, avg(x) AS m FROM (
        SELECT author_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM unit) GROUP BY 1, 2) GROUP BY 1),
    interp_means AS (SELECT author_id, list(m ORDER BY pos) AS v FROM (SELECT author_id, pos, avg(x) AS m FROM (
        SELECT author_id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, unnest(generate_series(1, len(v))) AS pos
        FROM inner_space) GROUP BY 1, 2) GROUP BY 1),
    sims AS (SELECT a.author_id AS query_id, b.author_id AS candidate_id, round(list_dot_product(a.v, b.v), 9) AS latent,
        round(list_dot_product(x.v, y.v), 9) AS interp FROM latent_means a JOIN latent_means b ON a.author_id <> b.author_id
        JOIN interp_means x ON x.author_id = a.author_id JOIN interp_means y ON y.author_id = b.author_id),
    """ + PLACED + """,
    shown AS (SELECT c.author_id, c.document_id, b.cluster_label, (list_dot_product(u.v, b.base) + 1) / 2 AS score
        FROM chosen c JOIN unit u ON u.document_id = c.document_id, bases b),
    best AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY round(score, 9) DESC, cluster_label) AS rank FROM shown)"""


@query("explain_prediction_authors", space_sql(IDF, COUNTS, WEIGHTS, BASES, TOP, TEXTS, REPRESENTATIVE, AUTHOR_SPACES) + """
    SELECT m.query_id, m.candidate_id, m.latent_rank, m.interp_rank, q.document_id AS query_document,
        s.document_id AS candidate_document, q.rank, q.cluster_label, round(q.score, 6) + 0.0 AS query_score,
        round(s.score, 6) + 0.0 AS score, t.features, t.summary
    FROM matches m JOIN best q ON q.author_id = m.query_id AND q.rank <= 2
    JOIN shown s ON s.author_id = m.candidate_id AND s.cluster_label = q.cluster_label
    LEFT JOIN texts t ON t.cluster_label = q.cluster_label""")
def _explain_prediction_authors(t: Tables):
    _, _, centroids, weights = space(t)
    docs = t.docs.select("author_id", F.col("document_id").alias("id"), F.col("embedding").alias("vector"))
    rows = explain.explain_prediction_authors(docs, centroids, weights, top_c=2, candidates=BEST)
    return rows.select("query_id", "candidate_id", "latent_rank", "interp_rank", "query_document", "candidate_document",
                       "rank", "cluster_label", r6("query_score", "query_score"), r6("score", "score"), "features", "summary")


@query("ranked_features", space_sql(IDF, COUNTS, WEIGHTS, BASES, SCORES, REPRESENTATIVE) + """
    SELECT c.document_id, t.feature, round(sum((list_dot_product(d.embedding, b.base)
        / sqrt(list_dot_product(d.embedding, d.embedding)) + 1) / 2 * t.weight)
        / (SELECT count(*) FROM bases), 6) + 0.0 AS weight
    FROM chosen c JOIN docs d ON d.document_id = c.document_id, bases b
    JOIN weights t ON t.cluster_label = b.cluster_label GROUP BY 1, 2""")
def _ranked_features(t: Tables):
    _, _, centroids, weights = space(t)
    docs = t.docs.select("author_id", F.col("document_id").alias("id"),
                         F.col("embedding").alias("vector"))
    scores = explain.author_cluster_scores(docs, explain.directions(centroids))
    return explain.ranked_features(scores, weights.filter("cluster_label <> -1")).select(
        "document_id", "feature", r6("weight", "weight"))
