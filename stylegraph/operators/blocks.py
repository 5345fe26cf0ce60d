"""Vector-by-vector work in bounded blocks.

Rows are hashed into blocks of limited size, each a file of the shared folder. A task takes
one block and reads those it meets one after the other, so no row is copied for each block. Only
what the kernel keeps (top matches, counts, forest edges) leaves a task: pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from stylegraph.sources.staging import settle

BLOCK_ROWS = 8192        # most rows of one side a task holds
TILE_ROWS = 512          # rows multiplied at a time inside a task
SMALL_SIDE_BYTES = 32 << 20   # a side below this may travel with the tasks
SPREAD_ROWS = 512        # split smaller inputs too, so that all cores work
TASKS_A_CORE = 4         # tasks per core, if there are fewer blocks

Kernel = Callable[[pa.Table, pa.Table], pa.Table]
#: Makes one result of two that a kernel gave for the same left block.
Merge = Callable[[pa.Table, pa.Table], pa.Table]


def matrix(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """An ``array<double>`` column as a row matrix."""
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def block_count(rows: int, block_rows: int) -> int:
    return max(1, math.ceil(rows / block_rows), min(4, rows // SPREAD_ROWS))


def block_of(df: DataFrame, blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def fits_beside(right: DataFrame, block_rows: int = BLOCK_ROWS) -> bool:
    """Whether a side is small enough, by count and width, to travel with the tasks."""
    rows = right.count()
    if rows == 0:
        return True
    return rows <= block_rows and rows * right.select(
        F.size("vector")).first()[0] * 8 <= SMALL_SIDE_BYTES


def product(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str,
            block_rows: int = BLOCK_ROWS, merge: Merge | None = None) -> DataFrame:
    """Run ``kernel(left_block, right_block)`` for every pair of blocks.

    Both inputs have ``id`` and ``vector`` columns (others are passed along).
    A right side whose measured size is small is sent to the tasks that already
    hold the left rows, which then do not move at all. Else a task streams the files of
    right blocks past a left block; with ``merge`` it gives one result for all it has met.
    """
    right = settle(right, "right")
    if fits_beside(right, block_rows):
        side = right.toArrow()

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and side.num_rows:
                    yield from kernel(pa.Table.from_batches([batch]), side).to_batches()

        return left.mapInArrow(beside, schema)

    left = settle(left, "left")
    lefts, rights = (block_files(side, block_count(side.count(), block_rows)) for side in (left, right))
    share = shares(left, len(lefts), len(rights))
    return stream(left, [(i, range(at, len(rights), share)) for i in range(len(lefts)) for at in range(share)],
                  lefts, rights, kernel, schema, merge)


def self_product(rows: DataFrame, kernel: Kernel, schema: str,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every unordered pair of blocks once; the kernel must treat both sides alike.

    ``kernel`` gets the same rows twice for a block paired with itself.
    """
    rows = settle(rows, "rows")
    files = block_files(rows, block_count(rows.count(), block_rows))
    share = shares(rows, len(files), len(files))
    # the first blocks meet the most others
    pairs = [(i, range(i + at, len(files), share)) for i in range(len(files)) for at in range(share)]
    return stream(rows, [p for p in pairs if len(p[1])], files, files, kernel, schema)


def block_files(rows: DataFrame, blocks: int) -> list[str]:
    """Files of the shared folder that hold about as many rows each, dealt by their ids."""
    return sorted(settle(rows.repartition(blocks, "id"), "blocks").inputFiles())


def shares(df: DataFrame, lefts: int, rights: int) -> int:
    """How many tasks the partners of a block are dealt to, so that all cores work."""
    wanted = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(rights, -(-wanted // max(lefts, 1))))


def block_table(file: str) -> pa.Table:
    system, path = pa.fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as opened:
        return pq.ParquetFile(opened).read()


def stream(df: DataFrame, pairs: list[tuple[int, range]], lefts: list[str], rights: list[str], kernel: Kernel,
           schema: str, merge: Merge | None = None) -> DataFrame:
    """Run ``kernel`` on one block of ``lefts`` and some of ``rights`` a task, which are told apart by ``_lb`` and ``_rb``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                i, others = pairs[at]
                own, held = block_table(lefts[i]), None
                for j in others if own.num_rows else ():
                    other = own if lefts[i] == rights[j] else block_table(rights[j])
                    if not other.num_rows:
                        continue
                    found = kernel(*[t.append_column("_lb", pa.repeat(pa.scalar(i), t.num_rows)).append_column(
                        "_rb", pa.repeat(pa.scalar(j), t.num_rows)) for t in (own, other)])
                    if merge is None:
                        yield from found.to_batches()
                    else:
                        held = found if held is None else merge(held, found)
                if held is not None:
                    yield from held.to_batches()

    return df.sparkSession.range(0, len(pairs), 1, max(1, min(len(pairs), 100_000))).mapInArrow(run, schema)


def cogroup_blocks(l: DataFrame, r: DataFrame, keys: list[str], pairs: int, kernel: Kernel,
             schema: str) -> DataFrame:
    # An explicit number of partitions keeps small but costly blocks apart.
    parts = max(1, min(pairs, 100_000))
    empty = pa.schema(arrow_schema(schema))

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty.empty_table()
        return kernel(lt, rt)

    # fresh column identities, as both sides may come from the same table
    r = r.select(*[F.col(c).alias(c) for c in r.columns])
    return (l.repartition(parts, *keys).groupBy(*keys)
            .cogroup(r.repartition(parts, *keys).groupBy(*keys))
            .applyInArrow(run, schema))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def top_matches(left: DataFrame, right: DataFrame, k: int, digits: int = 9,
                block_rows: int = BLOCK_ROWS, ascending: bool = False,
                exclude_same: bool = False) -> DataFrame:
    """The ``k`` right rows with the largest dot product for every left row.

    Returns ``(id, match, score, rank)``. Scores are ranked at ``digits`` places
    and ties go to the smaller match, so the outcome does not depend on blocks.
    """
    id_type = left.schema["id"].dataType.simpleString()
    match_type = right.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, match {match_type}, score double"
    out = arrow_schema(schema)
    sign = 1.0 if ascending else -1.0

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        order = pc.sort_indices(rt.column("id"))
        rt = rt.take(order)
        a, b = matrix(lt), matrix(rt)
        ids, matches = lt.column("id"), rt.column("id")
        same_id = np.asarray(matches.to_pylist(), dtype=object) if exclude_same else None
        picked_l, picked_r, picked_s = [], [], []
        for start in range(0, len(a), TILE_ROWS):
            scores = a[start:start + TILE_ROWS] @ b.T
            cost = sign * np.round(scores, digits)
            if exclude_same:
                here = np.asarray(ids.slice(start, TILE_ROWS).to_pylist(), dtype=object)
                cost[here[:, None] == same_id[None, :]] = np.inf
            take = min(k, b.shape[0])
            limit = np.partition(cost, take - 1, axis=1)[:, take - 1:take]
            row, col = np.nonzero((cost <= limit) & np.isfinite(cost))
            # nonzero yields rows in order; stable sort keeps the smaller id first
            by = np.lexsort((col, cost[row, col], row))
            row, col = row[by], col[by]
            first = np.r_[0, np.nonzero(np.diff(row))[0] + 1] if len(row) else np.array([], int)
            seen = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            keep = seen < k
            row, col = row[keep], col[keep]
            picked_l.append(row + start)
            picked_r.append(col)
            picked_s.append(scores[row, col])
        l = np.concatenate(picked_l) if picked_l else np.array([], int)
        r = np.concatenate(picked_r) if picked_r else np.array([], int)
        s = np.concatenate(picked_s) if picked_s else np.array([])
        return pa.table([ids.take(pa.array(l)), matches.take(pa.array(r)), pa.array(s)],
                        schema=out)

    def merge(held: pa.Table, found: pa.Table) -> pa.Table:
        both = pa.concat_tables([held, found]).combine_chunks()
        by = pc.sort_indices(both.column("match")).to_numpy()
        row = pc.fill_null(both.column("id").combine_chunks().dictionary_encode().indices, -1).to_numpy()[by]
        order = np.lexsort((sign * np.round(both.column("score").to_numpy()[by], digits), row))
        row, by = row[order], by[order]
        seen = np.arange(len(row)) - np.searchsorted(row, row)
        return both.take(pa.array(by[seen < k]))

    partial = product(left, right, kernel, schema, block_rows, merge)
    score = F.round("score", digits)
    score = score.asc() if ascending else score.desc()
    w = Window.partitionBy("id").orderBy(score, F.col("match").asc())
    return (partial.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k))


def score_vectors(left: DataFrame, right: DataFrame,
                  score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Scores of each left row against all right rows: ``(id, labels, scores)``,
    lists in the order of the right ids."""
    kind = left.schema["id"].dataType.simpleString()
    label = right.schema["id"].dataType.simpleString()
    schema = f"id {kind}, labels array<{label}>, scores array<double>"
    out = arrow_schema(schema)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        rt = rt.take(pc.sort_indices(rt.column("id")))
        grid = score(matrix(lt), matrix(rt))
        ends = np.arange(lt.num_rows + 1, dtype=np.int32) * rt.num_rows
        names = pa.concat_arrays([rt.column("id").combine_chunks()] * lt.num_rows)
        return pa.table([lt.column("id"), pa.ListArray.from_arrays(ends, names),
                         pa.ListArray.from_arrays(ends, pa.array(grid.ravel()))], schema=out)

    right = settle(right, "right")
    parts = product(left, right, kernel, schema)
    if fits_beside(right):
        return parts
    # one row per block of the right side: put them together in order
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("labels", "scores"))))
    return parts.groupBy("id").agg(pairs.alias("p")).select(
        "id", F.col("p.labels").alias("labels"), F.col("p.scores").alias("scores"))
