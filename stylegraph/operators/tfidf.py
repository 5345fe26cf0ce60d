"""Weights of style features per cluster.

Style assignments are long rows ``(document_id, feature)``; a feature listed
twice for a document counts twice. Everything stays in long form: a cluster or
a feature holding much of the data is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stylegraph.operators.skew import global_index, lookup_join, word_join


def select_feature(styles: DataFrame, column: str, document: str = "document_id") -> DataFrame:
    return styles.select(F.col(document).alias("document_id"), F.col(column).alias("feature"))


def drop_nan(rows: DataFrame, feature: str = "feature") -> DataFrame:
    return rows.filter(F.col(feature).isNotNull() & (F.col(feature) != "nan"))


def feature_idf(assignments: DataFrame) -> DataFrame:
    """``ln(documents / rows of the feature)`` as ``(feature, rows, idf)``.

    Rows are counted, not documents, so a frequent feature may get a negative
    weight.
    """
    documents = assignments.agg(F.count_distinct("document_id").alias("n")).scalar()
    return (assignments.filter(F.col("feature").isNotNull())
            .groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("idf", F.log(documents / F.col("rows"))))


def attach_cluster(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each document the cluster of its author."""
    return lookup_join(docs, labels.select("author_id", "cluster_label"), ["author_id"])


def cluster_style_counts(assignments: DataFrame, clustered_docs: DataFrame) -> DataFrame:
    """Rows per feature and cluster: ``(cluster_label, feature, n)``."""
    members = clustered_docs.select("document_id", "cluster_label")
    present = assignments.filter(F.col("feature").isNotNull())
    return (lookup_join(present, members, ["document_id"])
            .groupBy("cluster_label", "feature").agg(F.count(F.lit(1)).alias("n")))


def cluster_tfidf(counts: DataFrame, idf: DataFrame, log_counts: bool = False) -> DataFrame:
    """Weights ``(cluster_label, feature, weight)``: count, or ln(1+count), times idf."""
    n = F.log1p(F.col("n")) if log_counts else F.col("n")
    return counts.join(idf.select("feature", "idf"), "feature", "left").select(
        "cluster_label", "feature",
        F.when(F.col("idf").isNotNull(), n * F.col("idf")).otherwise(0.0).alias("weight"))


def cluster_tfidf_matrix(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """Cells ``(cluster_label, feature_index, weight)`` of the cluster x vocabulary
    matrix; cells not listed are 0. The vocabulary is numbered in order."""
    vocabulary = global_index(idf.select("feature"), ["feature"], "feature_index")
    return lookup_join(weights, vocabulary, ["feature"]).select(
        "cluster_label", "feature_index", "weight")


def doc_feature_matrix(assignments: DataFrame, requested: DataFrame) -> DataFrame:
    """Ones ``(document_id, feature_index, value)`` of the document x vocabulary
    matrix. A requested document without features has one row with no index."""
    present = assignments.filter(F.col("feature").isNotNull())
    vocabulary = global_index(present.select("feature").distinct(), ["feature"], "feature_index")
    ones = word_join(present.select("document_id", "feature").distinct(), vocabulary,
                     "feature").select("document_id", "feature_index")
    return (requested.select("document_id").distinct().join(ones, "document_id", "left")
            .withColumn("value", F.when(F.col("feature_index").isNull(), 0).otherwise(1)
                        .cast("bigint")))


def best_first(rows: DataFrame, group: str, value: str, tie: str, k: int,
               rank: str = "feature_rank") -> DataFrame:
    """The ``k`` largest values per group. The limit is applied before the shuffle
    too, so a huge group sends ``k`` rows per task."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(tie).asc())
    return rows.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def top_features(weights: DataFrame, k: int = 5) -> DataFrame:
    """Top features of each cluster, positive weights only."""
    return best_first(weights.filter("weight > 0"), "cluster_label", "weight", "feature", k)


def top_features_tfidf(weights: DataFrame, k: int | None = 5) -> DataFrame:
    """Top features of each cluster; the text "nan" is dropped after the cut."""
    if k is None:
        return drop_nan(weights)
    return drop_nan(best_first(weights, "cluster_label", "weight", "feature", k))


def topn_by_weight(weights: Column) -> Column:
    """Entries of a feature -> weight map, heaviest first."""
    return F.transform(
        F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct(
            (-e["value"]).alias("by"), e["key"].alias("feature")))),
        lambda e: F.struct(e["feature"].alias("feature"), (-e["by"]).alias("weight")))


def doc_feature_lists(assignments: DataFrame, pos: str = "pos") -> DataFrame:
    """Features of each document in order (as many as one document has)."""
    rows = F.array_sort(F.collect_list(F.struct(pos, "feature")))
    return assignments.filter(F.col("feature").isNotNull()).groupBy("document_id").agg(
        rows.alias("_rows")).select(
        "document_id", F.col("_rows.feature").alias("features"))


def attach_doc_styles(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Feature list per document, empty when it has none."""
    return docs.join(lists, "document_id", "left").withColumn(
        "features", F.coalesce("features", F.array().cast("array<string>")))


def author_features(docs: DataFrame, assignments: DataFrame, pos: str = "pos") -> DataFrame:
    """Features of an author's documents, in order, duplicates kept, as long rows
    ``(author_id, document_id, pos, feature)``; sorting by those columns gives
    the author's list."""
    return docs.select("author_id", "document_id").join(
        assignments.select("document_id", pos, "feature"), "document_id")


def cluster_documents(clustered_docs: DataFrame) -> DataFrame:
    """Documents of each cluster as long rows."""
    return clustered_docs.select("cluster_label", "document_id")


def docs_with_styles(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    return docs.join(assignments.select("document_id"), "document_id", "left_semi")


def cluster_feature_set(assignments: DataFrame, clustered_docs: DataFrame) -> DataFrame:
    """Distinct features per cluster as long rows."""
    return cluster_style_counts(assignments, clustered_docs).select("cluster_label", "feature")


def feature_vocabulary(weights: DataFrame) -> DataFrame:
    return weights.select("feature").distinct()


def feature_level(levels: DataFrame, pos: str = "pos") -> DataFrame:
    """Linguistic level of each feature, the last one written wins.

    ``levels(pos, level_map)`` holds one level map per document, in order.
    """
    exploded = (levels.select(pos, F.posexplode(F.map_entries("level_map")).alias("at", "e"))
                .select(pos, "at", F.col("e.key").alias("level"),
                        F.posexplode("e.value").alias("line", "feature")))
    return exploded.groupBy("feature").agg(
        F.max_by("level", F.struct(pos, "at", "line")).alias("level"))


def tfidf_representation(assignments: DataFrame, clustered_docs: DataFrame,
                         k: int = 5) -> DataFrame:
    """Top features per cluster by ln(1+count) * idf; noise is left out."""
    members = clustered_docs.filter("cluster_label <> -1")
    counts = cluster_style_counts(assignments, members)
    return top_features_tfidf(
        cluster_tfidf(counts, feature_idf(assignments), log_counts=True), k)


def with_cluster_features(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Add the cut feature list (``top_features`` rows) of each row's cluster."""
    lists = top.groupBy("cluster_label").agg(F.array_sort(F.collect_list(F.struct(
        "feature_rank", "feature", "weight"))).alias("features"))
    return lookup_join(rows, lists, ["cluster_label"])
