"""Explaining documents and predictions by clusters and their features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stylegraph.functions.vectors import (cosine, dot, l2_normalize, rescale_unit, vector_mean)
from stylegraph.operators.blocks import BLOCK_ROWS, TILE_ROWS, arrow_schema, matrix, product, score_vectors, top_matches
from stylegraph.operators.hooks import summarize
from stylegraph.operators.skew import lookup_join
from stylegraph.operators.tfidf import best_first, with_cluster_features
from stylegraph.sources.staging import settle

# Scores are ranked at so many places.
RANK_DIGITS = 9


def directions(centroids: DataFrame, normalize: bool = True) -> DataFrame:
    """Cluster centroids as ``(id, vector)`` rows; noise is left out when normalizing."""
    rows = centroids.filter("cluster_label <> -1") if normalize else centroids
    vector = F.col("centroid")
    return rows.select(F.col("cluster_label").alias("id"),
                       (l2_normalize(vector) if normalize else vector).alias("vector"))


def interpretable_vectors(docs: DataFrame, bases: DataFrame) -> DataFrame:
    """Dot products of each document with all bases: ``(id, labels, scores)``.

    ``docs(id, vector)`` and ``bases(id, vector)``; lists are in label order.
    """
    return score_vectors(docs, bases, lambda a, b: a @ b.T)


#: Bases of one space that a task takes in.
FACTOR_ROWS = 4096


def narrow_bases(bases: DataFrame) -> DataFrame:
    """Bases ``(space, id, vector)`` with the same products between projections, at most as many as vectors are wide.

    ``bases(space, id, vector)``. With the bases as rows of B = QR, the scores Bx and By of two documents have the
    product of Rx and Ry, so cosines between documents need R alone. R is made of the R of parts of the bases.
    """
    kind = bases.schema["space"].dataType.simpleString()
    schema = f"space {kind}, id bigint, vector array<double>"
    out = arrow_schema(schema)

    def factor(table: pa.Table, start: int) -> pa.Table:
        table = table.sort_by("id")
        r = np.linalg.qr(matrix(table), mode="r")
        return pa.table([pa.repeat(table.column("space")[0], len(r)), pa.array(range(start, start + len(r)), pa.int64()),
                         pa.array(list(r), pa.list_(pa.float64()))], schema=out)

    bases = settle(bases.select("space", "id", "vector"), "bases")
    parts = bases.count() // FACTOR_ROWS + 1
    cut = bases.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    first = cut.groupBy("space", "part").applyInArrow(lambda key, table: factor(table, key[1].as_py() * FACTOR_ROWS), schema)
    return first.groupBy("space").applyInArrow(lambda table: factor(table, 0), schema)


def score_rows(vectors: DataFrame) -> DataFrame:
    """``interpretable_vectors`` in long form ``(id, cluster_label, score)``."""
    return vectors.select("id", F.explode(F.arrays_zip("labels", "scores")).alias("e")).select(
        "id", F.col("e.labels").alias("cluster_label"), F.col("e.scores").alias("score"))


def rank_clusters(docs: DataFrame, bases: DataFrame, top_c: int,
                  reverse: bool = False) -> DataFrame:
    """Closest clusters of each document ``(document_id, rank, cluster_label, score)``."""
    found = top_matches(docs, bases, top_c, ascending=reverse)
    return found.select(F.col("id").alias("document_id"), "rank",
                        F.col("match").alias("cluster_label"), "score")


def explain_documents(docs: DataFrame, centroids: DataFrame, weights: DataFrame,
                      top_c: int = 3, top_k: int = 5, reverse: bool = False) -> DataFrame:
    """Top features of the closest clusters, in rank order, as long rows.

    ``docs(id, vector)``; ``reverse`` takes the least similar clusters. Nothing
    is shuffled by document while the centroids fit the measured limit.
    """
    ranked = rank_clusters(docs, directions(centroids), top_c, reverse)
    top = best_first(weights.filter("cluster_label <> -1"), "cluster_label", "weight",
                     "feature", top_k)
    listed = with_cluster_features(ranked, top)
    return listed.withColumn("f", F.explode("features")).select(
        "document_id", "rank", "cluster_label", "score", "f.feature_rank", "f.feature",
        "f.weight")


def two_spaces(docs: DataFrame, bases: DataFrame) -> DataFrame:
    """``(id, labels, scores, latent, interp)``: scores on the bases, and unit vectors of both spaces."""
    docs = settle(docs.select("id", "vector"), "docs")
    inner = settle(interpretable_vectors(docs, bases), "inner")
    return settle(docs.join(inner, "id").select(
        "id", "labels", "scores", l2_normalize(F.col("vector")).alias("latent"), l2_normalize(F.col("scores")).alias("interp")), "spaces")


def columns_of(table: DataFrame, *columns) -> DataFrame:
    """Columns of a written table, which need not be written again to be joined."""
    out = table.select(*columns)
    out._stylegraph_written = getattr(table, "_stylegraph_written", False)
    return out


def rank_candidates(spaces: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each query in either space, with their ranks in both.

    ``spaces(id, latent, interp)`` are vectors whose dot products are the scores; every
    row but the query itself is a candidate. Returns ``(query_id, candidate_id, latent,
    interp, latent_rank, interp_rank)``, ranks among all candidates, ties by the smaller id.
    """
    picked = None
    for name in SPACES:
        every = columns_of(spaces, "id", F.col(name).alias("vector"))
        asked = every.join(query_ids.select(F.col("query_id").alias("id")), "id", "left_semi")
        here = top_matches(asked, every, k, exclude_same=True).select(
            F.col("id").alias("query_id"), F.col("match").alias("candidate_id"))
        picked = here if picked is None else picked.unionByName(here)
    return rank_matches(spaces, picked.distinct())


SPACES = ("latent", "interp")
#: Matches of a query whose ranks are counted together; a query with more has several rows.
MATCHES_A_ROW = 1024


def rank_matches(spaces: DataFrame, matches: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ranks of given ``matches(query_id, candidate_id)`` among all rows of ``spaces``, as in ``rank_candidates``.

    The rank of a match is one more than the number of candidates before it. Every pair of blocks
    counts how many of its candidates lie before each match, and the counts are added: no
    table of queries and candidates is formed.
    """
    def side(name: str, mark: str) -> DataFrame:
        return columns_of(spaces, F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{mark}_{c}") for c in SPACES])

    pairs = lookup_join(lookup_join(matches, side("query", "q"), ["query_id"]), side("candidate", "c"), ["candidate_id"])
    pairs = settle(pairs.select("query_id", "candidate_id", *[
        F.round(dot(F.col(f"q_{c}"), F.col(f"c_{c}")), RANK_DIGITS).alias(c) for c in SPACES]), "pairs")
    part = F.pmod(F.xxhash64("candidate_id"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("query_id")) / MATCHES_A_ROW))
    lists = pairs.withColumn("part", part).groupBy("query_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("candidate_id", *SPACES))).alias("m"))
    wanted = lookup_join(lists, side("query", "q"), ["query_id"]).select(
        F.col("query_id").alias("id"), "part", F.col("m.candidate_id").alias("candidates"),
        *[F.col(f"m.{c}").alias(f"{c}_scores") for c in SPACES], *[F.col(f"q_{c}").alias(c) for c in SPACES])
    kind = spaces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, part bigint, candidates array<{kind}>, latent_before array<bigint>, interp_before array<bigint>"
    out = arrow_schema(schema)

    def count(lt: pa.Table, rt: pa.Table) -> pa.Table:
        rt = rt.take(pc.sort_indices(rt.column("id")))
        ids = rt.column("id").combine_chunks()
        own = pc.fill_null(pc.index_in(lt.column("id").combine_chunks(), value_set=ids), -1).to_numpy()
        found = {}
        for c in SPACES:
            left, right = matrix(lt, c), matrix(rt, c)
            before = []
            for start in range(0, len(left), TILE_ROWS):
                grid = np.rint(left[start:start + TILE_ROWS] @ right.T * 10 ** RANK_DIGITS)
                for i, row in enumerate(grid, start):
                    if own[i] >= 0:
                        row[own[i]] = -np.inf           # the query is no candidate
                    scores = np.rint(np.array(lt.column(f"{c}_scores")[i].values) * 10 ** RANK_DIGITS)
                    ranked = np.sort(row)
                    high, low = (np.searchsorted(ranked, scores, w) for w in ("right", "left"))
                    n = len(row) - high
                    for j in np.flatnonzero(high > low):        # of equal ones those with a smaller id
                        same = ids.take(pa.array(np.flatnonzero(row == scores[j])))
                        n[j] += pc.sum(pc.less(same, lt.column("candidates")[i].values[j])).as_py() or 0
                    before.append(n)
            found[c] = pa.array(before, pa.list_(pa.int64()))
        return pa.table([lt.column("id"), lt.column("part"), lt.column("candidates"), found["latent"], found["interp"]], schema=out)

    def add(held: pa.Table, found: pa.Table) -> pa.Table:
        for i, f in enumerate(out):
            if f.name.endswith("_before"):
                old, new = (t.column(i).combine_chunks() for t in (held, found))
                held = held.set_column(i, f, pa.ListArray.from_arrays(old.offsets, pc.add(old.values, new.values)).cast(f.type))
        return held

    right = columns_of(spaces, "id", F.col("latent").alias("vector"), *SPACES)
    counts = product(wanted.withColumn("vector", F.col("latent")), right, count, schema, block_rows, add)
    each = counts.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip(
        "candidates", "latent_before", "interp_before")).alias("e"))
    ranks = each.groupBy("query_id", F.col("e.candidates").alias("candidate_id")).agg(
        *[(F.sum(f"e.{c}_before") + 1).alias(f"{c}_rank") for c in SPACES])
    return pairs.join(ranks, ["query_id", "candidate_id"])


def cluster_texts(weights: DataFrame, top_k: int = 5, generate=None) -> DataFrame:
    """What a reader sees of each cluster: ``(cluster_label, features, summary)``.

    The ``top_k`` heaviest features in order. The summary is their text joined by dashes, or one
    paragraph by the text generator. Noise is left out.
    """
    top = best_first(weights.filter("cluster_label <> -1"), "cluster_label", "weight", "feature", top_k)
    lists = top.groupBy("cluster_label").agg(F.array_sort(F.collect_list(F.struct("feature_rank", "feature"))).alias("f"))
    lists = lists.select("cluster_label", F.col("f.feature").alias("features"))
    if generate is None:
        return lists.withColumn("summary", F.array_join("features", " - "))
    return summarize(lists, generate)


def explain_matches(ranks: DataFrame, shown: DataFrame, texts: DataFrame, top_c: int = 3) -> DataFrame:
    """For each match the clusters its query is closest to, in words, with both sides' scores on them.

    ``ranks(query_id, candidate_id, ...)``, ``shown(id, labels, scores)`` and ``texts(cluster_label, ...)``.
    Adds ``rank, cluster_label, query_score, score`` and the columns of ``texts``. Scores are
    picked from the lists by their place; a cluster without features keeps its row.
    """
    cells = F.transform(F.arrays_zip("labels", "scores"), lambda c, i: F.struct(
        (-F.round(c["scores"], RANK_DIGITS)).alias("far"), c["labels"].alias("label"), i.alias("at"), c["scores"].alias("own")))
    closest = F.slice(F.array_sort(cells), 1, top_c)
    queries = settle(shown.join(ranks.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("query_id"), closest.alias("closest")), "closest")
    candidates = columns_of(shown, F.col("id").alias("candidate_id"), "scores")
    both = lookup_join(lookup_join(ranks, queries, ["query_id"]), candidates, ["candidate_id"])
    long = both.select(*ranks.columns, "scores", F.posexplode("closest").alias("pos", "c")).select(
        *ranks.columns, (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("c.label").alias("cluster_label"),
        F.col("c.own").alias("query_score"), F.get("scores", F.col("c.at")).alias("score"))
    return lookup_join(long, texts, ["cluster_label"], "left")


def explain_prediction(docs: DataFrame, query_ids: DataFrame, centroids: DataFrame, weights: DataFrame,
                       top_c: int = 3, top_k: int = 5, candidates: int = 10,
                       matches: DataFrame | None = None, generate=None) -> DataFrame:
    """Explain which documents a query is attributed to, and by which style.

    ``docs(id, vector)``. All other documents are candidates of a query; the best ``candidates``
    in either space are explained, or the given ``matches(query_id, candidate_id)``. Returns
    ``(query_id, candidate_id, latent, interp, latent_rank, interp_rank, rank, cluster_label,
    query_score, score, features, summary)``, a row per match and cluster of the query.
    """
    spaces = two_spaces(docs, directions(centroids))
    ranks = rank_candidates(spaces, query_ids, candidates) if matches is None else rank_matches(spaces, matches)
    return explain_matches(settle(ranks, "ranks"), spaces, cluster_texts(weights, top_k, generate), top_c)


def representative_document(docs: DataFrame) -> DataFrame:
    """Per author the document closest to the author's mean vector.

    ``docs(author_id, id, vector)`` gives ``(author_id, document_id, closeness)``.
    """
    means = docs.groupBy("author_id").agg(vector_mean(F.col("vector")).alias("mean"),
                                          F.count(F.lit(1)).alias("n"))
    scored = lookup_join(docs, means, ["author_id"], counted="n").select(
        "author_id", "id", F.round(cosine(F.col("vector"), F.col("mean")), 9).alias("closeness"))
    # the smaller id wins a tie
    best = F.min(F.struct((-F.col("closeness")).alias("far"), F.col("id")))
    return scored.groupBy("author_id").agg(best.alias("b")).select(
        "author_id", F.col("b.id").alias("document_id"), (-F.col("b.far")).alias("closeness"))


def author_spaces(docs: DataFrame, bases: DataFrame) -> DataFrame:
    """``(id, latent, interp)`` per author: the means of the unit vectors of ``docs(author_id, id, vector)``.

    The dot product of two of them is the mean cosine over all pairs of the two authors'
    documents, so no pair of documents is formed.
    """
    unit = docs.select("author_id", "id", l2_normalize(F.col("vector")).alias("vector"))
    inner = interpretable_vectors(unit.select("id", "vector"), bases)
    return settle(unit.join(inner.select("id", "scores"), "id").groupBy(F.col("author_id").alias("id")).agg(
        vector_mean(F.col("vector")).alias("latent"), vector_mean(l2_normalize(F.col("scores"))).alias("interp")), "spaces")


def explain_prediction_authors(docs: DataFrame, centroids: DataFrame, weights: DataFrame, top_c: int = 3, top_k: int = 5,
                               candidates: int = 10, query_ids: DataFrame | None = None, generate=None) -> DataFrame:
    """``explain_prediction`` for authors; every author is a query unless ``query_ids(query_id)`` are given.

    An author is shown by the most representative document, with scores rescaled to [0, 1]:
    ``query_document`` and ``candidate_document`` name them.
    """
    bases = settle(directions(centroids), "bases")
    spaces = author_spaces(docs, bases)
    asked = query_ids if query_ids is not None else spaces.select(F.col("id").alias("query_id"))
    ranks = rank_candidates(spaces, asked, candidates)
    chosen = settle(representative_document(docs), "chosen")
    unit = docs.join(chosen.select(F.col("document_id").alias("id")), "id", "left_semi").select(
        "id", l2_normalize(F.col("vector")).alias("vector"))
    scores = interpretable_vectors(unit, bases).select(
        F.col("id").alias("document_id"), "labels", rescale_unit(F.col("scores")).alias("scores"))
    shown = settle(chosen.join(scores, "document_id").select(F.col("author_id").alias("id"), "labels", "scores"), "shown")
    for side in ("query", "candidate"):
        named = columns_of(chosen, F.col("author_id").alias(f"{side}_id"), F.col("document_id").alias(f"{side}_document"))
        ranks = lookup_join(ranks, named, [f"{side}_id"])
    return explain_matches(settle(ranks, "ranks"), shown, cluster_texts(weights, top_k, generate), top_c)


def author_cluster_scores(docs: DataFrame, bases: DataFrame) -> DataFrame:
    """Scores of each author's representative document, rescaled to [0, 1]:
    ``(author_id, document_id, cluster_label, score)``."""
    chosen = representative_document(docs)
    unit = docs.join(chosen.select(F.col("document_id").alias("id")), "id", "left_semi").select(
        "id", l2_normalize(F.col("vector")).alias("vector"))
    scores = interpretable_vectors(unit, bases).select(
        "id", "labels", rescale_unit(F.col("scores")).alias("scores"))
    return (chosen.select("author_id", "document_id")
            .join(score_rows(scores).withColumnRenamed("id", "document_id"), "document_id"))


def ranked_features(scores: DataFrame, weights: DataFrame, key: str = "document_id") -> DataFrame:
    """Feature weight of a document: mean over all clusters of score x weight.

    ``scores(key, cluster_label, score)`` and ``weights(cluster_label, feature,
    weight)``; a feature a cluster lacks counts 0.
    """
    clusters = scores.agg(F.count_distinct("cluster_label").alias("n")).scalar()
    return (scores.join(weights, "cluster_label").groupBy(key, "feature")
            .agg(F.sum(F.col("score") * F.col("weight")).alias("_s"))
            .select(key, "feature", (F.col("_s") / clusters).alias("weight")))
