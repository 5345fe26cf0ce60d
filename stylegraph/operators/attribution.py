"""Scoring candidate authors against query authors, and splitting authors.

Documents are long rows ``(author_id, document_id, embedding)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stylegraph.functions.vectors import dot, l2_normalize, vector_mean
from stylegraph.operators import metrics
from stylegraph.operators.blocks import (BLOCK_ROWS, TILE_ROWS, arrow_schema, matrix, product,
                                         top_matches)
from stylegraph.operators.skew import in_parts, lookup_join
from stylegraph.sources.staging import settle


def group_by_author(docs: DataFrame, part_rows: int = 1024, **options) -> DataFrame:
    """Texts and ids of each author in id order, ``part_rows`` documents per row."""
    return in_parts(docs, ["author_id"], ["document_id"], ["document_id", "text"],
                    part_rows, **options)


def join_texts(parts: DataFrame, separator: str) -> DataFrame:
    """Joined text of each part; an author's parts in order give the whole text."""
    return parts.select("author_id", "part", F.array_join("text", separator).alias("full_text"))


def author_directions(docs: DataFrame) -> DataFrame:
    """Mean unit vector per author as ``(id, vector)``.

    The dot product of two of them is the mean cosine over all pairs of the two
    authors' documents.
    """
    unit = l2_normalize(F.col("embedding").cast("array<double>"))
    return docs.groupBy(F.col("author_id").alias("id")).agg(vector_mean(unit).alias("vector"))


def author_pair_score(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidate authors per query author:
    ``(query_author, candidate_author, rank, score)``."""
    found = top_matches(settle(author_directions(queries), "queries"),
                        settle(author_directions(candidates), "candidates"), k)
    return found.select(F.col("id").alias("query_author"),
                        F.col("match").alias("candidate_author"), "rank", "score")


def mask_pairs(scores: DataFrame, assigned: DataFrame) -> DataFrame:
    """Score 0 where the candidate is not assigned to the query."""
    pairs = assigned.select("query_author", "candidate_author").distinct().withColumn(
        "_in", F.lit(True))
    return scores.join(pairs, ["query_author", "candidate_author"], "left").withColumn(
        "score", F.when(F.col("_in"), F.col("score")).otherwise(0.0)).drop("_in")


def masked_score_bins(queries: DataFrame, candidates: DataFrame, matches: DataFrame, assigned: DataFrame,
                      digits: int = metrics.DIGITS) -> DataFrame:
    """``score_bins`` of the masked matrix: 0 where the candidate is not assigned to the query.

    ``assigned(query_author, candidate_author)``. Only assigned cells are scored; all others share the
    score 0 and are counted, so the work grows with the assigned pairs, not with the matrix.
    """
    q, c = (settle(author_directions(rows), name) for rows, name in ((queries, "queries"), (candidates, "candidates")))
    keys = ["query_author", "candidate_author"]
    hits = matches.select(*keys).distinct().withColumn("pos", F.lit(1))

    def known(pairs: DataFrame) -> DataFrame:
        for rows, key, name in ((q, "query_author", "_q"), (c, "candidate_author", "_c")):
            side = rows.select(F.col("id").alias(key), F.col("vector").alias(name))
            side._stylegraph_written = True         # columns of a written table
            pairs = lookup_join(pairs, side, [key])
        return pairs

    cells = known(assigned.select(*keys).distinct()).join(hits, keys, "left")
    score = (F.rint(dot(F.col("_q"), F.col("_c")) * 10 ** digits) / 10 ** digits + F.lit(0.0)).alias("score")
    scored = settle(cells.select(score, F.coalesce("pos", F.lit(0)).alias("pos")).groupBy("score").agg(
        F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n")), "bins")
    seen = scored.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    rest = q.count() * c.count() - seen.n
    # hits among authors that are there, but not assigned
    missed = known(hits.select(*keys)).count() - seen.pos
    others = scored.sparkSession.createDataFrame([(0.0, missed, rest)] if rest else [], scored.schema)
    return scored.unionByName(others).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).select(
        "score", "pos", (F.col("n") - F.col("pos")).alias("neg"))


def score_bins(queries: DataFrame, candidates: DataFrame, matches: DataFrame,
               digits: int = metrics.DIGITS, block_rows: int = BLOCK_ROWS,
               assigned: DataFrame | None = None) -> DataFrame:
    """All cells of the query x candidate matrix as counts per score.

    ``matches(query_author, candidate_author)`` are the hits. Cells are scored
    block by block and only counts per rounded score leave a task, at most
    ``2 * 10**digits + 1`` rows in the end. ``assigned`` masks the matrix.
    """
    if assigned is not None:
        return masked_score_bins(queries, candidates, matches, assigned, digits)
    q = settle(author_directions(queries), "queries")
    c = settle(author_directions(candidates), "candidates")
    schema = "bin bigint, n bigint"
    out = arrow_schema(schema)
    unit = 10 ** digits

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        a, b = matrix(lt), matrix(rt)
        bins, counts = [], []
        for start in range(0, len(a), TILE_ROWS):
            grid = np.rint(a[start:start + TILE_ROWS] @ b.T * unit).astype(np.int64)
            uniq, n = np.unique(grid, return_counts=True)
            bins.append(uniq)
            counts.append(n)
        return pa.table([pa.array(np.concatenate(bins)), pa.array(np.concatenate(counts))],
                        schema=out)

    cells = product(q, c, kernel, schema, block_rows).groupBy("bin").agg(F.sum("n").alias("n"))
    hits = matches.select("query_author", "candidate_author").distinct()
    hits = lookup_join(hits, q.select(F.col("id").alias("query_author"),
                                      F.col("vector").alias("_q")), ["query_author"])
    hits = lookup_join(hits, c.select(F.col("id").alias("candidate_author"),
                                      F.col("vector").alias("_c")), ["candidate_author"])
    found = hits.groupBy(F.rint(dot(F.col("_q"), F.col("_c")) * unit).cast("bigint").alias("bin")
                         ).agg(F.count(F.lit(1)).alias("pos"))
    both = cells.join(found, "bin", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    return both.select((F.col("bin") / unit + F.lit(0.0)).alias("score"), "pos",
                       (F.col("n") - F.col("pos")).alias("neg"))


def attribution_eer_auc(bins: DataFrame) -> DataFrame:
    """EER and AUC over all cells: one row ``(eer, auc)``."""
    bins = settle(bins, "bins")
    eer = metrics.equal_error_rate(bins.withColumn("_k", F.lit(0)), ["_k"]).select("eer")
    return eer.withColumn("auc", metrics.auc(bins).scalar())


def training_pair_counts(queries: DataFrame, candidates: DataFrame,
                         matches: DataFrame) -> DataFrame:
    """How many positive pairs each author contributes:
    ``(kind, query_author, candidate_author, pairs)``.

    Pairs inside an author and across matched authors grow with the square of an
    author's documents, so they are counted, not listed.
    """
    def sizes(docs: DataFrame, name: str) -> DataFrame:
        return docs.groupBy(F.col("author_id").alias(name)).agg(
            F.count(F.lit(1)).alias(f"{name}_docs"))

    q, c = sizes(queries, "query_author"), sizes(candidates, "candidate_author")

    def inside(rows: DataFrame, name: str) -> Column:
        n = F.col(f"{name}_docs")
        return (n * (n - 1) / 2).cast("bigint").alias("pairs")

    kind = q.schema["query_author"].dataType
    none = F.lit(None).cast(kind)
    within_q = q.select(F.lit("query").alias("kind"), "query_author",
                        none.alias("candidate_author"), inside(q, "query_author"))
    within_c = c.select(F.lit("candidate").alias("kind"), none.alias("query_author"),
                        "candidate_author", inside(c, "candidate_author"))
    pairs = matches.select("query_author", "candidate_author").distinct()
    across = pairs.join(q, "query_author").join(c, "candidate_author").select(
        F.lit("match").alias("kind"), "query_author", "candidate_author",
        (F.col("query_author_docs") * F.col("candidate_author_docs")).alias("pairs"))
    return within_q.unionByName(within_c).unionByName(across)


def _share(author: Column) -> Column:
    """A number in [0, 1000) drawn from the author's name."""
    return F.conv(F.substring(F.md5(author.cast("string")), 1, 8), 16, 10).cast("bigint") % 1000


def authors_in_split(rows: DataFrame, split: DataFrame, author: str = "author_id") -> DataFrame:
    return rows.join(split.select(F.col("author_id").alias(author)), author, "left_semi")


def leftover_candidates(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """Distinct candidate authors that no split holds yet."""
    return candidates.select("author_id").distinct().join(
        placed.select("author_id"), "author_id", "left_anti")


def split_authors(queries: DataFrame, candidates: DataFrame, matches: DataFrame,
                  valid_share: float = 0.15) -> DataFrame:
    """Train and validation authors without leaks: ``(role, split, author_id)``.

    Query authors are split at random (by a hash, so runs agree); candidates
    follow the query authors they match; the rest is split at random too.
    """
    limit = round(valid_share * 1000)

    def side(author: Column) -> Column:
        return F.when(_share(author) < limit, "valid").otherwise("train")

    q = queries.select("author_id").distinct().withColumn("split", side(F.col("author_id")))
    followed = matches.join(q.withColumnRenamed("author_id", "query_author"), "query_author")
    placed = followed.select(F.col("candidate_author").alias("author_id"), "split").distinct()
    rest = leftover_candidates(candidates, placed).withColumn("split", side(F.col("author_id")))
    return (q.select(F.lit("query").alias("role"), "split", "author_id")
            .unionByName(placed.unionByName(rest).select(
                F.lit("candidate").alias("role"), "split", "author_id")))


def split_matches(matches: DataFrame, split: DataFrame) -> DataFrame:
    """Ground truth cut to each side: ``(split, query_author, candidate_author)``."""
    q = split.filter("role = 'query'").select("split", F.col("author_id").alias("query_author"))
    c = split.filter("role = 'candidate'").select(
        "split", F.col("author_id").alias("candidate_author"))
    return (matches.select("query_author", "candidate_author").join(q, "query_author")
            .join(c, ["split", "candidate_author"])
            .select("split", "query_author", "candidate_author"))


def attribute_and_evaluate(queries: DataFrame, candidates: DataFrame, matches: DataFrame,
                           path: str, k: int, assigned: DataFrame | None = None) -> DataFrame:
    """Write the ``k`` best candidates of every query author and return EER and AUC over all pairs.

    ``assigned(query_author, candidate_author)`` masks the scores: 0 for all other pairs. The written list then
    holds assigned candidates only, the best ``k`` of each query.
    """
    from stylegraph.sources.documents import write_scores

    if assigned is None:
        scores = author_pair_score(queries, candidates, k)
    else:
        scores = assigned_scores(queries, candidates, assigned, k)
    write_scores(scores, path)
    return attribution_eer_auc(score_bins(queries, candidates, matches, assigned=assigned))


def assigned_scores(queries: DataFrame, candidates: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """The ``k`` best assigned candidates per query author, as ``author_pair_score`` gives them."""
    pairs = assigned.select("query_author", "candidate_author").distinct()
    for rows, key, name in ((queries, "query_author", "_q"), (candidates, "candidate_author", "_c")):
        pairs = lookup_join(pairs, author_directions(rows).select(F.col("id").alias(key), F.col("vector").alias(name)), [key])
    scored = pairs.select("query_author", "candidate_author", F.round(dot(F.col("_q"), F.col("_c")), 9).alias("score"))
    best = Window.partitionBy("query_author").orderBy(F.col("score").desc(), "candidate_author")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
