"""Distance joins between vectors, reduced inside each block.

``forest_edges`` is the base of clustering: it keeps, per pair of blocks, only a
minimum spanning forest of the distances up to a limit. By the cycle property
the forest of all kept edges equals the forest of all pairs, so nothing is lost
while at most one edge per row and block leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.operators.blocks import (BLOCK_ROWS, TILE_ROWS, arrow_schema,
                                         cogroup_blocks, matrix, self_product)
from stylegraph.operators.graph import grow_forest
from stylegraph.sources.staging import settle

DIGITS = 9
MAX_PIVOTS = 1024

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances between unit rows."""
    return np.round(1.0 - a @ b.T, DIGITS)


def euclidean_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a ** 2).sum(1)[:, None] - 2.0 * a @ b.T + (b ** 2).sum(1)[None, :]
    return np.round(np.sqrt(np.maximum(square, 0.0)), DIGITS)


def word_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing positions of word-code rows that were padded with 0."""
    return np.stack([(b != row).sum(axis=1) for row in a]).astype(float)


def _same_block(lt: pa.Table) -> bool:
    return lt.column("_lb")[0] == lt.column("_rb")[0]


def _forest_kernel(kind: str, limit: float, distance: Distance):
    schema = f"a {kind}, b {kind}, d double"
    out = arrow_schema(schema)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        both = lt.select(["id", "vector"])
        if not _same_block(lt):
            both = pa.concat_tables([both, rt.select(["id", "vector"])])
        ids, m = both.column("id").combine_chunks(), matrix(both)
        a, b, d = grow_forest(len(ids), lambda i: distance(m[i:i + 1], m)[0], limit)
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d)], schema=out)

    return kernel, schema


def forest_edges(rows: DataFrame, limit: float, distance: Distance = cosine_distance,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b, d)`` whose spanning forest is that of all pairs with d <= limit.

    ``rows`` has ``id`` and ``vector``; for cosine the vectors are unit length.
    """
    rows = settle(rows.select("id", "vector"), "points")
    kernel, schema = _forest_kernel(rows.schema["id"].dataType.simpleString(), limit, distance)
    if distance is cosine_distance and limit < 0.5 and rows.count() > 4 * block_rows:
        return _pivot_join(rows, limit, kernel, schema, block_rows)
    return self_product(rows, kernel, schema, block_rows)


def _pivot_join(rows: DataFrame, limit: float, kernel, schema: str,
                block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """Compare only vectors whose cells lie within the limit of each other.

    Every vector belongs to the cell of its nearest pivot and also visits a lower
    numbered cell when it lies within the limit of the plane between the two
    pivots; two vectors within the limit therefore always meet. Cells of any
    size are cut into bounded blocks.
    """
    count = pivots or min(MAX_PIVOTS, math.isqrt(rows.count()))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").toArrow()
    centres = np.unique(matrix(picked), axis=0)
    reach = math.sqrt(2.0 * limit) + 1e-6       # chord length of the cosine limit
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed_schema = f"{fields}, cell int, home boolean"
    out = arrow_schema(placed_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table, m = pa.Table.from_batches([batch]), matrix(batch)
            square = ((m ** 2).sum(1)[:, None] - 2.0 * m @ centres.T
                      + (centres ** 2).sum(1)[None, :])
            home = square.argmin(1)
            near = square[np.arange(len(m)), home]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (square - near[:, None]) / (2.0 * gaps[home])
            visits = (plane <= reach) & (np.arange(len(centres))[None, :] < home[:, None])
            row, cell = np.nonzero(visits)
            take = np.r_[np.arange(len(m)), row]
            cells = np.r_[home, cell].astype(np.int32)
            own = np.r_[np.ones(len(m), bool), np.zeros(len(row), bool)]
            moved = table.take(pa.array(take))
            yield from pa.table([*moved.columns, pa.array(cells), pa.array(own)],
                                schema=out).to_batches()

    placed = rows.mapInArrow(place, placed_schema)
    # one row per pivot, so at most MAX_PIVOTS rows
    blocks = placed.groupBy("cell").agg(
        F.ceil(F.count_if("home") / block_rows).cast("int").alias("homes"),
        F.ceil(F.count_if(~F.col("home")) / block_rows).cast("int").alias("guests"))
    blocks = F.broadcast(blocks)
    sized = placed.join(blocks, "cell").withColumn(
        "_b", F.when(F.col("home"), F.pmod(F.xxhash64("id"), "homes"))
        .otherwise(F.col("homes") + F.pmod(F.xxhash64("id"), "guests")).cast("int"))
    last = F.col("homes") + F.col("guests") - 1
    l = (sized.filter("home").withColumn("_rb", F.explode(F.sequence(F.col("_b"), last)))
         .withColumnRenamed("_b", "_lb"))
    upto = F.when(F.col("home"), F.col("_b")).otherwise(F.col("homes") - 1)
    r = (sized.filter("homes > 0").withColumn("_lb", F.explode(F.sequence(F.lit(0), upto)))
         .withColumnRenamed("_b", "_rb"))
    pairs = max(count, math.ceil(rows.count() / block_rows) ** 2)
    keys = ["cell", "_lb", "_rb"]
    slim = ["id", "vector", *keys]
    return cogroup_blocks(l.select(*slim), r.select(*slim), keys, pairs, kernel, schema)


def neighbour_counts(rows: DataFrame, eps: float, distance: Distance = cosine_distance,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How many other rows lie within ``eps`` of each row: ``(id, neighbours)``."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint"
    out = arrow_schema(schema)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        same = _same_block(lt)
        a, b = matrix(lt), matrix(rt)
        here = np.zeros(len(a), np.int64)
        there = np.zeros(len(b), np.int64)
        for start in range(0, len(a), TILE_ROWS):
            near = distance(a[start:start + TILE_ROWS], b) <= eps
            here[start:start + TILE_ROWS] = near.sum(axis=1)
            there += near.sum(axis=0)
        here -= 1 if same else 0      # a row is not its own neighbour
        left = pa.table([lt.column("id"), pa.array(here)], schema=out)
        if same:
            return left
        return pa.concat_tables([left, pa.table([rt.column("id"), pa.array(there)], schema=out)])

    parts = self_product(rows.select("id", "vector"), kernel, schema, block_rows)
    return parts.groupBy("id").agg(F.sum("n").alias("neighbours"))
