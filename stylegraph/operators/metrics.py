"""Retrieval metrics of rankings.

Tables of scores are rounded to ``digits`` before ranking. Equal scores share a row from
then on, so a query has at most about ``2 * 10**digits`` rows however many
candidates it was compared with. Documents ranked against all others
(``leave_one_out``) are ranked inside tasks, at the full precision of their scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F, types as T

from stylegraph.functions.vectors import dot, l2_normalize, vector_sum
from stylegraph.operators.blocks import arrow_schema, matrix, unit_rows
from stylegraph.sources.staging import settle

DIGITS = 6


def score_bins(ranked: DataFrame, keys: list[str], score: str = "score",
               hit: str = "hit", digits: int = DIGITS) -> DataFrame:
    """``(*keys, score, pos, neg)``: how many hits and misses share a score."""
    return (ranked.groupBy(*keys, (F.round(score, digits) + F.lit(0.0)).alias("score"))
            .agg(F.count_if(F.col(hit) == 1).alias("pos"),
                 F.count_if(F.col(hit) != 1).alias("neg")))


def _cumulative(bins: DataFrame, keys: list[str]) -> DataFrame:
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return (bins.withColumn("tps", F.sum("pos").over(upto))
            .withColumn("fps", F.sum("neg").over(upto))
            .withColumn("p", F.sum("pos").over(whole))
            .withColumn("n", F.sum("neg").over(whole)))


def equal_error_rate(bins: DataFrame, keys: list[str]) -> DataFrame:
    """EER per key; 1 when there is no hit or no miss.

    The curve keeps its first and last point and those where the step of hits
    or misses changes; the origin comes first.
    """
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    points = _cumulative(bins, keys)
    for c in ("tps", "fps"):
        points = (points.withColumn(f"{c}_in", F.col(c) - F.lag(c).over(down))
                  .withColumn(f"{c}_out", F.lead(c).over(down) - F.col(c)))
    edge = F.col("tps_in").isNull() | F.col("tps_out").isNull()
    turn = (F.col("tps_in") != F.col("tps_out")) | (F.col("fps_in") != F.col("fps_out"))
    kept = points.filter(edge | turn).select(
        *keys, F.col("score").alias("at"), "p", "n",
        (1 - F.try_divide("tps", "p")).alias("fnr"), F.try_divide("fps", "n").alias("fpr"))
    # the origin has fnr 1 and fpr 0; it is met before every score
    gap = F.abs(F.col("fnr") - F.col("fpr"))
    first = F.min(F.when((F.col("p") > 0) & (F.col("n") > 0), F.struct(
        F.round(gap, 12).alias("gap"), (-F.col("at")).alias("order"),
        ((F.col("fnr") + F.col("fpr")) / 2).alias("eer")))).alias("best")
    best = kept.groupBy(*keys).agg(first, F.max("p").alias("p"), F.max("n").alias("n"))
    return best.select(*keys, F.when((F.col("p") == 0) | (F.col("n") == 0), 1.0).when(
        F.col("best.gap") >= 1.0, 0.5).otherwise(F.col("best.eer")).alias("eer"))


def average_precision(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; 0 without hits."""
    part = F.try_divide("pos", "p") * F.col("tps") / (F.col("tps") + F.col("fps"))
    return _cumulative(bins, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("pos") > 0, part).otherwise(0.0)).alias("ap"))


def ndcg(bins: DataFrame, keys: list[str]) -> DataFrame:
    """NDCG with linear gain; equal scores share their average gain; 0 without hits."""
    # rows of one score fill the ranks from ``before + 1`` to ``upto``
    upto = F.col("tps") + F.col("fps")
    size = F.col("pos") + F.col("neg")
    ranked = _cumulative(bins, keys).filter("pos > 0").select(
        *keys, "p", "pos", size.alias("size"), (upto - size).alias("before"))
    gained = ranked.withColumn("gain", F.col("pos") / F.col("size") * _discounts(
        F.col("before"), F.col("size")))
    got = gained.groupBy(*keys).agg(F.sum("gain").alias("dcg"), F.max("p").alias("p"))
    ideal = got.withColumn("ideal", _discounts(F.lit(0).cast("bigint"), F.col("p")))
    have = ideal.select(*keys, (F.col("dcg") / F.col("ideal")).alias("ndcg"))
    return (bins.select(*keys).distinct().join(have, keys, "left")
            .withColumn("ndcg", F.coalesce("ndcg", F.lit(0.0))))


_CUMULATIVE = np.zeros(1)


@F.pandas_udf(T.DoubleType())
def _discounts(before: pd.Series, size: pd.Series) -> pd.Series:
    """Sum of 1/log2(rank + 1) over the ranks before+1 .. before+size."""
    global _CUMULATIVE
    upto = (before + size).to_numpy()
    if len(upto) and upto.max() >= len(_CUMULATIVE):
        ranks = np.arange(1, 2 * int(upto.max()) + 1)
        _CUMULATIVE = np.r_[0.0, np.cumsum(1.0 / np.log2(ranks + 1.0))]
    return pd.Series(_CUMULATIVE[upto] - _CUMULATIVE[before.to_numpy()])


def ranking_metrics(bins: DataFrame, keys: list[str]) -> DataFrame:
    """EER, average precision and NDCG per key."""
    return (equal_error_rate(bins, keys).join(average_precision(bins, keys), keys)
            .join(ndcg(bins, keys), keys))


def rank_one(scores: np.ndarray, hits: np.ndarray, discounts: np.ndarray) -> tuple:
    """EER, average precision and NDCG of one ranking held in memory.

    The same rules as above for a query whose candidates fit one task;
    ``discounts`` are the cumulative rank discounts, starting with 0.
    """
    hits = np.asarray(hits, bool)
    return rank_sorted(np.sort(scores), scores[hits], discounts)


def rank_sorted(ranked: np.ndarray, found: np.ndarray, discounts: np.ndarray) -> tuple:
    """:func:`rank_one` by the ``ranked`` scores, ascending, and those of the hits among them.

    Only scores of hits and scores that occur more than once are looked at: between them the curve is a
    straight line, of which it keeps the ends.
    """
    if not len(found):
        return 1.0, 0.0, 0.0
    values, pos = np.unique(found, return_counts=True)
    values, pos = values[::-1], pos[::-1]
    size = np.searchsorted(ranked, values, "right")
    upto = np.searchsorted(ranked, values)
    size, upto = size - upto, len(ranked) - upto
    tps = np.cumsum(pos)
    p, n = tps[-1], len(ranked) - tps[-1]
    ap = float((pos / p * tps / upto).sum())
    gain = pos / size * (discounts[upto] - discounts[upto - size])
    quality = float(gain.sum() / discounts[int(p)])
    if n == 0:
        return 1.0, ap, quality
    tied = ranked[1:] == ranked[:-1]
    if tied.any():
        hit, times = (len(ranked) - upto)[::-1], pos[::-1]
        first = np.flatnonzero(tied[1:] > tied[:-1]) + 1
        start = np.union1d(np.append(first, 0) if tied[0] else first, hit)         # of each such score
        place = np.minimum(np.searchsorted(hit, start), len(hit) - 1)
        pos = np.where(hit[place] == start, times[place], 0)[::-1]
        size = (np.searchsorted(ranked, ranked[start], "right") - start)[::-1]
        upto, tps = (len(ranked) - start)[::-1], np.cumsum(pos)
    before = upto - size
    apart = before > np.append(0, upto[:-1])        # a score of a single miss comes right before
    goes_on = np.append(~apart[1:] & (pos[1:] == pos[:-1]) & (size[1:] == size[:-1]), False)
    goes_on[0] &= before[0] > 0                     # the first point is kept anyway
    at = np.concatenate([[1] if before[0] else [], before[apart], upto[~goes_on], [len(ranked)]])
    true = np.concatenate([[0] if before[0] else [], (tps - pos)[apart], tps[~goes_on], [p]])
    order = np.argsort(at, kind="stable")
    at, true = at[order], true[order]
    fnr = np.r_[1.0, 1 - true / p]
    fpr = np.r_[0.0, (at - true) / n]
    best = int(np.argmin(np.round(np.abs(fnr - fpr), 12)))
    return float((fnr[best] + fpr[best]) / 2), ap, quality


#: Scores of documents are compared at so many places; what lies below is the noise of doubles.
LOO_DIGITS = 12
#: Bytes of scores that one task holds, most queries of a task, and rows of a block of candidates.
TILE_BYTES, TILE_QUERIES, PACKED_ROWS = 256 << 20, 2048, 2048
#: Documents of a space in a file of packed blocks, roughly.
FILE_ROWS = 1 << 16


def leave_one_out(docs: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Rank all other documents for each document; a hit has the same author.

    ``docs(space, id, author_id, vector)``, ids unique in their space; the score is the cosine and
    spaces are independent. Returns one row per document ``(space, id, hits, misses, mean_hit, eer,
    ap, ndcg)``.

    A task owns a tile of queries. All blocks of candidates stream past it from the shared folder, each
    leaves a run of scores, and when the last one has passed the task sorts the scores of each query
    and ranks them. So pairs never become rows, and no candidate is copied for a tile. A tile
    has as many queries as ``tile_bytes`` hold with the scores of all documents; blocks are packed once, as
    bytes of unit vectors that a task takes as they are.
    """
    docs = settle(docs.select("space", "id", "author_id", "vector"), "docs")
    sizes = docs.groupBy("space").count().agg(F.max("count"), F.sum("count"), F.count("count")).first()
    largest, rows, spaces = (n or 1 for n in sizes)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # a score and a hit are nine bytes; small tables are dealt to all cores too
    queries = max(1, min(tile_bytes // (9 * largest), TILE_QUERIES, -(-rows // cores)))
    kind, author, space = (docs.schema[c].dataType.simpleString() for c in ("id", "author_id", "space"))
    packed_schema = f"space {space}, block int, ids array<{kind}>, authors array<{author}>, rows binary"
    packed_out = arrow_schema(packed_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1)
                unit = unit_rows(block.column("flat").flatten().to_numpy(zero_copy_only=False).reshape(
                    len(block.column("ids").flatten()), -1))
                yield pa.RecordBatch.from_arrays([*block.columns[:4], pa.array([unit.tobytes()], pa.binary())], schema=packed_out)

    files_a_space = max(1, -(-largest // FILE_ROWS))
    place = F.pmod(F.xxhash64("id"), F.lit(-(-largest // PACKED_ROWS))).cast("int")
    packed = settle(docs.groupBy("space", place.alias("block")).agg(
        F.collect_list(F.struct("id", "author_id", "vector")).alias("rows")).select(
        "space", "block", F.col("rows.id").alias("ids"), F.col("rows.author_id").alias("authors"),
        F.flatten("rows.vector").alias("flat")).repartition(
            spaces * files_a_space, "space", F.pmod("block", F.lit(files_a_space))).mapInArrow(pack, packed_schema), "packed")
    files: dict = {}
    for r in packed.groupBy("space", F.input_file_name().alias("file")).count().orderBy("file").collect():
        files.setdefault(r["space"], []).append(r["file"])       # some files per space
    schema = f"space {space}, id {kind}, hits bigint, misses bigint, mean_hit double, eer double, ap double, ndcg double"
    out = arrow_schema(schema)

    most, held = queries + queries // 4, {}     # tiles of a task share their memory

    def rank(table: pa.Table) -> pa.Table:
        done = []
        # a tile has about as many rows as it should; what is beyond is ranked in a second pass
        for at in range(0, table.num_rows, most):
            tile = QueryTile(table.slice(at, most), largest, held)
            for file in files[tile.space.as_py()]:
                for block in packed_blocks(file):
                    if block.column("space")[0] == tile.space:
                        tile.take(block)
            done += tile.ranked(out)
        return pa.Table.from_batches(done, schema=out)

    tiles = -(-largest // queries)
    # another hash than that of the blocks
    tile = F.pmod(F.xxhash64(F.lit("tile"), "id"), F.lit(tiles)).cast("int")
    return docs.withColumn("tile", tile).repartition(min(tiles * spaces, 32 * cores), "space", "tile").groupBy(
        "space", "tile").applyInArrow(rank, schema)


def packed_blocks(file: str) -> Iterator[pa.RecordBatch]:
    """Blocks of a Parquet file below the shared folder, one by one."""
    system, path = pa.fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as opened:
        for batch in pq.ParquetFile(opened).iter_batches(16):
            for at in range(batch.num_rows):
                yield batch.slice(at, 1)


class QueryTile:
    """The queries of one task with the scores of the candidates that have passed."""

    def __init__(self, queries: pa.Table, candidates: int, held: dict):
        self.space = queries.column("space")[0]
        self.ids = queries.column("id").combine_chunks()
        authors = queries.column("author_id").combine_chunks().dictionary_encode()
        self.author, self.authors = authors.indices.to_numpy(), authors.dictionary
        self.rows = unit_rows(matrix(queries))
        if len(held.get("scores", ())) < len(self.rows):
            held.clear()
            held.update(scores=np.empty((len(self.rows), candidates)), hits=np.empty((len(self.rows), candidates), bool))
        self.scores, self.hits = held["scores"][:len(self.rows)], held["hits"][:len(self.rows)]
        self.seen = 0

    def take(self, block: pa.RecordBatch) -> int:
        """Score a block of candidates as the next run."""
        ids, n = block.column("ids").flatten(), self.seen
        end = n + len(ids)
        rows = np.frombuffer(block.column("rows")[0].as_buffer()).reshape(len(ids), -1)
        scores = self.rows @ rows.T
        scores *= 10 ** LOO_DIGITS
        np.rint(scores, out=self.scores[:, n:end])
        # candidates of authors that nobody here has get -1
        author = pc.fill_null(pc.index_in(block.column("authors").flatten(), value_set=self.authors), -1).to_numpy()
        self.hits[:, n:end] = self.author[:, None] == author[None, :]
        own = pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy()
        at = np.flatnonzero(own >= 0)
        self.scores[own[at], n + at] = -np.inf      # a document is no candidate of its own
        self.seen = end
        return len(ids)

    def ranked(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        discounts = np.r_[0.0, np.cumsum(1 / np.log2(np.arange(1, self.seen + 1) + 1.0))]
        found = []
        for scores, hits in zip(self.scores[:, :self.seen], self.hits[:, :self.seen]):
            hit = scores[np.flatnonzero(hits)]
            hit = hit[hit > -np.inf]
            scores.sort()                           # nobody needs their places any more
            # no candidates lie before the others, scores that are no numbers behind them
            scores = scores[np.searchsorted(scores, -np.inf, "right"):np.searchsorted(scores, np.nan)]
            n = len(hit)
            mean = float(hit.mean() / 10 ** LOO_DIGITS) if n else None
            found.append((n, len(scores) - n, mean, *rank_sorted(scores, hit, discounts)))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(out)[2:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.space.as_py()] * len(found), out.field("space").type), self.ids.cast(out.field("id").type), *columns],
            schema=out)


def sweep_metrics(docs: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Mean quality per space of ``docs(space, id, author_id, vector)``:
    ``(space, eer, ap, ndcg, mean_sim)``, rounded to 3 places."""
    docs = settle(docs.select("space", "id", "author_id", "vector"), "docs")
    quality = leave_one_out(docs, tile_bytes).groupBy("space").agg(
        *[F.round(F.avg(c), 3).alias(c) for c in ("eer", "ap", "ndcg")])
    # the mean over all cells of the cosine matrix is the squared length of the mean unit vector
    total = docs.groupBy("space").agg(vector_sum(l2_normalize(F.col("vector"))).alias("s"), F.count(F.lit(1)).alias("n"))
    similarity = total.select("space", F.round(F.try_divide(
        dot(F.col("s"), F.col("s")), F.col("n") * F.col("n")), 3).alias("mean_sim"))
    return quality.join(similarity, "space")


def mean_similarity(docs: DataFrame) -> DataFrame:
    """Mean of the full cosine matrix, diagonal included, without forming pairs."""
    total = docs.agg(vector_sum(l2_normalize(F.col("vector"))).alias("s"),
                     F.count(F.lit(1)).alias("n"))
    return total.select(F.try_divide(dot(F.col("s"), F.col("s")), F.col("n") * F.col("n"))
                        .alias("mean_sim"))


def model_performance(docs: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row of mean EER, AP, NDCG over ``docs(id, author_id, vector)`` and the mean similarity."""
    return sweep_metrics(docs.withColumn("space", F.lit(0)), tile_bytes).drop("space")


def auc(bins: DataFrame) -> DataFrame:
    """Area under the curve of one ranking, ties counted half: one row ``auc``."""
    up = Window.orderBy(F.col("score").asc()).rowsBetween(Window.unboundedPreceding, -1)
    below = bins.withColumn("below", F.coalesce(F.sum("neg").over(up), F.lit(0)))
    return below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"),
                     F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def balanced_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean recall over the true classes: one row ``balanced_accuracy``."""
    recall = rows.groupBy(truth).agg(
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))
