"""Centroid clustering in exact integers with a progressive Walsh-Hadamard search.

The Walsh-Hadamard transform keeps squared distances up to the factor ``width``, and it
gathers what differs most between vectors in few coarse coefficients. A vector is
compared with all centroids on the coarse ones first; a centroid whose sum so far
already exceeds the whole distance of another one is strictly worse and leaves. Those
that stay are summed over all coefficients, so distances and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.llm.common import only
from stylegraph.sources.staging import settle

#: Components must lie within +-LARGEST, so that a squared distance fits a long.
LARGEST = 131_072
#: With coefficients up to here squared distances of 64 of them fit a long in the transform too.
SAFE = 1 << 27
#: Rows transformed or searched at a time.
ROWS = 4096


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, coarse coefficients (few sign changes) first."""
    n, width = rows.shape
    out, half = rows, 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return out[:, coarse_first(width)]


def coarse_first(width: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their Walsh function."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < width:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def restore(sums: list[int]) -> list[int]:
    """Integers whose transform is ``sums``; exact, as the transform is its own inverse times ``width``."""
    width = len(sums)
    plain = np.empty(width, object)
    plain[coarse_first(width)] = sums
    natural = np.empty(width, object)
    natural[coarse_first(width)] = transform(plain[None, :])[0]
    return [int(v) // width for v in natural]


def stages(width: int) -> list[tuple[int, int]]:
    """Ranges of coefficients, coarse to fine: 4, then three times as many as before."""
    cuts, at = [0], 4
    while at < width:
        cuts.append(at)
        at *= 4
    return list(zip(cuts, [*cuts[1:], width]))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each transformed row (ties: the smaller number), the squared distance, and
    how many coefficient differences were formed."""
    n, width = rows.shape
    if max(abs(rows).max(initial=0), abs(centroids).max(initial=0)) > SAFE:
        rows, centroids = rows.astype(object), centroids.astype(object)     # beyond longs: Python's integers
    every, worked = np.arange(n), 0
    total = np.zeros((n, len(centroids)), rows.dtype)
    row, number = np.divmod(np.arange(n * len(centroids)), len(centroids))
    for start, end in stages(width):
        gap = rows[row, start:end] - centroids[number, start:end]
        total[row, number] += (gap * gap).sum(1)
        worked += gap.size
        if end == width:
            break
        # the whole distance of the most promising one bounds the nearest
        best = np.full(n, -1)
        low = total.min(1, where=live(row, number, total.shape), initial=total.max(initial=0))
        hit = total[row, number] == low[row]
        best[row[hit][::-1]] = number[hit][::-1]
        gap = rows[:, end:] - centroids[best, end:]
        bound = total[every, best] + (gap * gap).sum(1)
        worked += gap.size
        stay = total[row, number] <= bound[row]
        row, number = row[stay], number[stay]
    alive = live(row, number, total.shape)
    total = np.where(alive, total, total.max(initial=0) + 1)
    chosen = total.argmin(1) if total.dtype != object else np.array([min(range(len(t)), key=t.__getitem__) for t in total], int)
    return chosen, total[every, chosen] // width, worked


def live(row: np.ndarray, number: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(shape, bool)
    mask[row, number] = True
    return mask


def kept_rows(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """``(vec_id, coefs)``: the transforms of the integer vectors of usable rows."""
    schema = pa.schema([("vec_id", pa.int64()), ("coefs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                whole = np.floor(scale * flat.reshape(part.num_rows, width)).astype(np.int64)
                coefs = transform(whole)
                ends = np.arange(0, coefs.size + 1, width, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(coefs.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists], schema=schema)

    x = F.col("embedding")
    # a null component makes forall null, NaN is larger than every number
    usable = (F.size(x) == width) & F.forall(x, lambda v: (v >= -LARGEST) & (v <= LARGEST))
    rows = only(vectors, vec_id="bigint", embedding="array<double>")
    return rows.filter(usable).mapInArrow(run, "vec_id bigint, coefs array<bigint>")


def over_batches(rows: DataFrame, width: int, work: Callable[[pa.Array, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield work(part.column("vec_id"), part.column("coefs").flatten().to_numpy().reshape(-1, width))
    return rows.mapInArrow(run, schema)


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums of the transforms per cluster: numbers of centroids, not of rows, reach the driver."""
    k, width = centroids.shape

    def sums(_, coefs: np.ndarray) -> pa.RecordBatch:
        found = nearest(coefs, centroids)[0]
        numbers = np.unique(found)
        # 4096 rows of coefficients below 2**34 add up to less than 2**46
        totals = [coefs[found == c].sum(0).tolist() for c in numbers]
        return pa.RecordBatch.from_arrays([
            pa.array(numbers, pa.int32()), pa.array(np.bincount(found)[numbers], pa.int64()),
            pa.array(totals, pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = over_batches(rows, width, sums, "cluster int, n bigint, sums array<bigint>")
    added = (parts.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
             .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "pos").collect():         # at most k * width rows
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.s))
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024,
                    seed: int = 3) -> DataFrame:
    """Clusters of ``vectors(vec_id, embedding)`` by integer centroids.

    A component x counts as ``floor(scale * x)``. The first centroids are the ``k`` rows with the
    smallest sha256 of ``seed:vec_id``; each of ``rounds`` rounds assigns every row to its nearest
    centroid and replaces each centroid that has rows by the floor of their mean; at last rows are
    assigned once more. Returns ``vec_id, cluster, distance`` (squared), ``cluster_inertia, inertia``
    (sums of distances) and ``centroid_sha256`` of the final centroid.

    ``width`` is a power of two. Rows whose vector is null, has another width, or a null, NaN or
    infinite component are left out; so are those with a component beyond +-131 072, whose distances would
    not fit a long. A null id hashes as empty text; rows that repeat an id are rows of their own,
    equal hashes go by their vectors. With fewer than ``k`` rows there are as many centroids as
    rows; an empty table gives no rows. Only centroids and their sums reach the driver.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    spark = vectors.sparkSession
    rows = settle(kept_rows(vectors, width, scale), "coefs")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = rows.select(name.alias("hash"), "coefs").orderBy("hash", "coefs").limit(k).collect()
    final = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], final)
    plain = [restore(r.coefs) for r in seeds]
    moved = np.array([r.coefs for r in seeds], np.int64)
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(rows, moved).items():
            plain[c] = [s // n for s in restore(sums)]          # floors, also below zero
        moved = transform(np.array(plain, np.int64))

    def assign(ids: pa.Array, coefs: np.ndarray) -> pa.RecordBatch:
        found, distance, _ = nearest(coefs, moved)
        return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                                          ["vec_id", "cluster", "distance"])

    placed = settle(over_batches(rows, width, assign, "vec_id bigint, cluster int, distance bigint"), "placed")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain]
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    listed = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string").join(inertia, "cluster")
    total = inertia.agg(F.sum("cluster_inertia")).first()[0]
    # one row per centroid
    return placed.join(F.broadcast(listed), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """DuckDB text of the same result, one set of tables per round."""
    def gap(v: str, c: str) -> str:
        return f"list_sum(list_transform(list_zip({v}, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
            SELECT r.row, r.vec_id, r.v, c.j, {gap('r.v', 'c.c')} AS d FROM rows r, c{i} c) GROUP BY row, vec_id, v)"""

    steps = [f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x:
            floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width}
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS j, v AS c
            FROM rows ORDER BY j LIMIT {k})"""]
    for i in range(rounds):
        steps.append(assigned(i))
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
            SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
            SELECT j, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x,
            unnest(generate_series(1, {width})) AS pos FROM a{i}) GROUP BY j, pos) GROUP BY j) m ON m.j = c.j)""")
    steps.append(assigned(rounds))
    return "WITH " + ",\n".join(steps) + f"""
        SELECT a.vec_id, a.j::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
            (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""
