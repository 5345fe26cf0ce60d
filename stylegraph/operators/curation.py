"""Curating the vocabulary of style features."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.functions.text import token_overlap, words
from stylegraph.operators import meetings
from stylegraph.operators.blocks import TILE_ROWS, arrow_schema, self_product
from stylegraph.operators.cluster import drop_noise, labels_of, small_clusters
from stylegraph.operators.graph import SMALL_EDGES, connected_components
from stylegraph.operators.profiles import profile_edges
from stylegraph.operators.skew import global_index, lookup_join, word_join
from stylegraph.sources.staging import settle

Affinity = Callable[[Column, Column], Column]


def _frequent(rows: DataFrame, item: str, test) -> DataFrame:
    keep = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(test(F.col("_n")))
    return word_join(rows, keep, item, counted="_n").drop("_n")


def min_frequency_filter(rows: DataFrame, feature: str = "feature", threshold: int = 2) -> DataFrame:
    """Rows whose feature occurs more than ``threshold`` times."""
    return _frequent(rows, feature, lambda n: n > threshold)


def drop_infrequent(rows: DataFrame, item: str, min_occurrences: int = 3) -> DataFrame:
    """Rows whose item occurs at least ``min_occurrences`` times; duplicates stay."""
    return _frequent(rows, item, lambda n: n >= min_occurrences)


def drop_nulls(rows: DataFrame) -> DataFrame:
    return rows.na.drop()


def distinct_features(rows: DataFrame, feature: str = "feature",
                      order: list[str] | None = None) -> DataFrame:
    """Distinct features numbered in first-seen order: ``(idx, feature)``."""
    first = rows.groupBy(F.col(feature).alias("feature")).agg(
        F.min(F.struct(*(order or ["pos"]))).alias("_first"))
    return global_index(first, ["_first", "feature"]).select("idx", "feature")


def map_with_fallback(rows: DataFrame, mapping: DataFrame, column: str, source: str,
                      target: str, into: str | None = None) -> DataFrame:
    """Replace a value by its mapped one, keeping values without a mapping."""
    known = mapping.select(F.col(source).alias(column), F.col(target).alias("_to"))
    return lookup_join(rows, known, [column], "left").withColumn(
        into or column, F.coalesce("_to", column)).drop("_to")


def _word_codes(features: DataFrame, name: str) -> DataFrame:
    code = F.transform(words(F.col("feature")),
                       lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 52) - 1)).cast("double"))
    return features.select(F.col("idx").alias("id"), code.alias(name))


def word_points(features: DataFrame) -> DataFrame:
    """``features(idx, feature)`` as equally long rows of word codes ``(id, vector)``."""
    coded = _word_codes(features, "c")
    width = max(coded.agg(F.max(F.size("c"))).first()[0] or 0, 1)
    padding = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("c"))
    return coded.select("id", F.concat("c", padding).alias("vector"))


def word_difference_neighbours(features: DataFrame, eps: float) -> DataFrame:
    """How many other features differ in at most ``eps`` words: ``(idx, neighbours)``."""
    return meetings.word_difference_counts(features, math.floor(eps))


def _by_length(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word codes, shortest first and padded with 0 to the longest of them, and their lengths."""
    lists = table.column("vector").combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    order = np.argsort(lengths, kind="stable")
    return out[order], lengths[order]


def _equal_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many positions each row of ``a`` equals each row of ``b``, positions being the first axis."""
    total, part = np.zeros((a.shape[1], b.shape[1]), np.int64), np.zeros((a.shape[1], b.shape[1]), np.uint8)
    for p in range(len(a)):
        part += (a[p][:, None] == b[p][None, :]).view(np.uint8)
        if p % 255 == 254:
            total += part
            part[:] = 0
    return total + part


def word_difference_histogram(features: DataFrame) -> DataFrame:
    """Number of feature pairs per word difference: ``(difference, pairs)``.

    All pairs are compared, in tiles of features of like length, only as far as the shorter ones of a tile go.
    """
    schema = "difference bigint, pairs bigint"
    out = arrow_schema(schema)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        (a, n), (b, m) = _by_length(lt), _by_length(rt)
        counts = np.zeros(max(a.shape[1], b.shape[1]) + 1, np.int64)
        for i in range(0, len(a), TILE_ROWS):
            x, nx = a[i:i + TILE_ROWS], n[i:i + TILE_ROWS]
            for j in range(0, len(b), TILE_ROWS):
                y, ny = b[j:j + TILE_ROWS], m[j:j + TILE_ROWS]
                width = min(nx[-1], ny[-1])
                same = _equal_words(np.ascontiguousarray(x[:, :width].T), np.ascontiguousarray(y[:, :width].T))
                # beyond the width one side has no words
                beyond = (x[:, width:] != 0).sum(1)[:, None] + (y[:, width:] != 0).sum(1)[None, :]
                counts += np.bincount((width - same + beyond).ravel(), minlength=len(counts))
        if lt.column("_lb")[0] == lt.column("_rb")[0]:
            counts[0] -= len(a)        # a row against itself
            counts //= 2               # every other pair was met twice
        at = np.nonzero(counts)[0]
        return pa.table([pa.array(at), pa.array(counts[at])], schema=out)

    parts = self_product(settle(_word_codes(features, "vector"), "words"), kernel, schema)
    return parts.groupBy("difference").agg(F.sum("pairs").alias("pairs"))


def word_clusters(features: DataFrame, eps: float = 10.0, metric: str = "direct",
                  max_features: int | None = None) -> DataFrame:
    """Clusters of similar features ``(idx, cluster_label)``, -1 for none.

    ``direct`` compares the word differences with ``eps``; ``profile`` compares
    the Euclidean distance of the rows of the difference matrix (:func:`profile_edges`);
    a caller may refuse more than ``max_features`` of them.
    """
    if metric == "profile":
        if max_features is not None and (count := features.count()) > max_features:
            raise ValueError(f"{count} features exceed max_features={max_features}; "
                             "use metric='direct'")
        points = settle(_word_codes(features, "vector"), "words")
        labels = labels_of(points, profile_edges(points, eps))
    else:
        features = settle(features.select("idx", "feature"), "features")
        labels = labels_of(features.select(F.col("idx").alias("id")),
                           meetings.word_difference_links(features, math.floor(eps)))
    return labels.withColumnRenamed("id", "idx")


def split_by_affinity(members: DataFrame, affinity: Affinity = token_overlap,
                      threshold: float = 0.5, below: int = 10) -> DataFrame:
    """Split small clusters into loose members and the rest.

    ``members(cluster_label, idx, feature)``. Clusters of ``below`` members or
    more and noise are left out, so that a cluster has fewer than 10 members and
    a handful of pairs. A member whose mean affinity to the others is at most the
    threshold stands alone. Returns ``(cluster_label, idx, feature, alone,
    group_idx)``, groups numbered as singletons first, then the rest.
    """
    small = settle(small_clusters(drop_noise(members), below=below), "small-clusters")
    other = small.select("cluster_label", F.col("idx").alias("other_idx"),
                         F.col("feature").alias("other"))
    pairs = small.join(other, "cluster_label").filter("idx <> other_idx")
    lower = F.col("idx") < F.col("other_idx")
    first = F.when(lower, F.col("feature")).otherwise(F.col("other"))
    second = F.when(lower, F.col("other")).otherwise(F.col("feature"))
    closeness = pairs.groupBy("cluster_label", "idx", "feature").agg(
        F.avg(affinity(first, second)).alias("closeness"))
    marked = closeness.withColumn("alone", F.col("closeness") <= threshold)
    group = marked.withColumn("_late", F.when(F.col("alone"), 0).otherwise(1)).withColumn(
        "_head", F.when(F.col("alone"), F.col("idx")).otherwise(F.lit(-1)))
    heads = group.select("cluster_label", "_late", "_head").distinct()
    numbered = global_index(heads, ["cluster_label", "_late", "_head"], "group_idx")
    return group.join(numbered, ["cluster_label", "_late", "_head"]).select(
        "cluster_label", "idx", "feature", "alone", "group_idx")


def overlap_edges(items: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``items(id, text)`` whose token sets have a
    Jaccard overlap of at least ``threshold``."""
    return meetings.overlapping_sets(items, threshold)


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges claimed in one round, of rows ``(part, a, b)`` that come part by part in the order of their edges.

    Edges pass by; only the groups of one part that have claimed or are claimed are remembered.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    current, taken = None, set()
    for batch in batches:
        ends = []
        for part, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b"))):
            if part != current:
                current, taken = part, set()
            if a not in taken and b not in taken:
                taken.update((a, b))
                ends.append((a, b))
        if ends:
            a, b = zip(*ends)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)


def merge_groups(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """Merge groups in rounds along ``edges(a, b)``, a < b: ``(group_idx, root)``.

    In a round every group, in order, claims its smallest later neighbour that is
    still free; claimed groups join the claiming one, whose first member keeps
    representing it. Rounds go on until nothing is claimed. Only groups that end
    up in another one are returned.

    Components of the edges do not touch each other: with more than ``small_edges`` edges, each passes through
    one task per round, sorted. In a component a claim may wait for all claims before it.
    """
    edges = settle(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct(),
                   "merge-edges")
    schema = "group_idx bigint, root bigint"
    if edges.count() <= small_edges:
        out = arrow_schema(schema)

        def solve(table: pa.Table) -> pa.Table:
            later: dict[int, list[int]] = {}
            for a, b in sorted(zip(table.column("a").to_pylist(), table.column("b").to_pylist())):
                later.setdefault(a, []).append(b)
            into: dict[int, int] = {}
            while True:
                gone: dict[int, int] = {}
                for a in sorted(later):
                    if a in into or a in gone:
                        continue
                    free = next((b for b in later[a] if b not in into and b not in gone), None)
                    if free is not None:
                        gone[free] = a
                if not gone:
                    break
                into.update(gone)

            def root(x: int) -> int:
                while x in into:
                    x = into[x]
                return x

            moved = sorted(into)
            return pa.table([pa.array(moved, pa.int64()),
                             pa.array([root(x) for x in moved], pa.int64())], schema=out)

        return edges.withColumn("_k", F.lit(0)).groupBy("_k").applyInArrow(solve, schema)

    parts = connected_components(edges).select(F.col("node").alias("a"), F.col("component").alias("part"))
    owner, alive = None, settle(lookup_join(edges, parts, ["a"]).select("part", "a", "b"), "alive")
    while not alive.isEmpty():
        claims = alive.repartition("part").sortWithinPartitions("part", "a", "b").mapInArrow(_claims, "a bigint, b bigint")
        moved = settle(claims.select(F.col("b").alias("group_idx"), F.col("a").alias("root")), "moved")
        if owner is None:
            owner = moved
        else:
            step = moved.select(F.col("group_idx").alias("root"), F.col("root").alias("_to"))
            owner = settle(owner.join(step, "root", "left").select(
                "group_idx", F.coalesce("_to", "root").alias("root")).unionByName(moved), "owner")
        gone = moved.select(F.col("group_idx").alias("x"))
        alive = settle(alive.join(gone.withColumnRenamed("x", "a"), "a", "left_anti")
                       .join(gone.withColumnRenamed("x", "b"), "b", "left_anti")
                       .select("part", "a", "b"), "alive")
    return owner if owner is not None else edges.select(
        F.col("b").alias("group_idx"), F.col("a").alias("root"))


def refine_features(features: DataFrame, eps: float = 10.0, split_threshold: float = 0.5,
                    merge_threshold: float = 0.8, metric: str = "direct",
                    affinity: Affinity = token_overlap,
                    close_pairs: Callable[[DataFrame, float], DataFrame] = overlap_edges,
                    max_features: int | None = None) -> DataFrame:
    """Near-duplicate features and their common name: ``(feature, canonical)``.

    ``features(idx, feature)``. ``affinity`` scores two features of a cluster and
    ``close_pairs`` finds the representatives ``(id, text)`` that reach the merge
    threshold; both default to token overlap. Features outside small clusters
    are absent and keep their name.
    """
    features = settle(features.select("idx", "feature"), "features")
    labels = word_clusters(features, eps, metric, max_features)
    members = labels.join(features, "idx")
    groups = settle(split_by_affinity(members, affinity, split_threshold), "groups")
    reps = groups.groupBy("group_idx").agg(F.min_by("feature", "idx").alias("text"))
    reps = settle(reps, "representatives")
    merged = merge_groups(close_pairs(reps.withColumnRenamed("group_idx", "id"), merge_threshold))
    rooted = groups.join(merged, "group_idx", "left").withColumn(
        "root", F.coalesce("root", "group_idx"))
    names = reps.select(F.col("group_idx").alias("root"), F.col("text").alias("canonical"))
    return lookup_join(rooted, names, ["root"]).select("feature", "canonical")


def canonical_features(rows: DataFrame, feature: str, order: list[str], compose: bool = True,
                       into: str = "aggregated_name", **options) -> DataFrame:
    """Two rounds of refining. With ``compose`` both rounds are applied in turn;
    without it the second round is looked up by the original name only."""
    first = refine_features(distinct_features(rows, feature, order), **options)
    rows = settle(map_with_fallback(rows, first, feature, "feature", "canonical", into), "round-1")
    second = refine_features(distinct_features(rows, into, order), **options)
    if compose:
        return map_with_fallback(rows, second, into, "feature", "canonical")
    return map_with_fallback(rows.drop(into), second, feature, "feature", "canonical", into)
