"""Packing documents into sequences by fitted length patterns.

Patterns of up to three lengths that fill a sequence exactly are enumerated; their
repeat counts are fitted to the histogram of lengths by non-negative least squares
and rounded down; what is left is packed best fit, longest first. All of this works
on the histogram, whose size is the capacity, however many documents there are.
The rows then find their places by their rank among the rows of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.llm.common import hashed_rank, only
from stylegraph.llm.encoding import REMEMBERED, encoded
from stylegraph.sources.staging import settle


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
           remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of whole texts: ``doc_id, piece, start, length, ids``.

    ``end_id`` closes each document. Only documents longer than ``capacity`` are cut; all
    their pieces are full but the first. ``ids`` are little-endian uint32. A null
    text is empty and gives one piece with the end id; null and repeated ids are
    carried along; no rows give no rows. A worker keeps the ids of ``remembered`` parts of texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encoded(batch.column("text"), tokenizer_path, end_id, remembered)):
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows.extend((doc_id, k, a, b - a, ids[a:b].tobytes())
                            for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return only(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that add up to ``capacity``; 0 is no length."""
    have = np.zeros(capacity + 1, bool)
    have[0] = True
    have[lengths] = True
    rows = []
    for a in np.flatnonzero(have[:capacity // 3 + 1]):
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        fine = have[b] & have[c] & ~((b == 0) & (a > 0))
        rows.append(np.stack([np.full(fine.sum(), a), b[fine], c[fine]], axis=1))
    return np.concatenate(rows)


def fit_repeats(found: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that bring ``sum(x * pattern)`` close to ``counts``.

    Least squares by projected gradients with momentum; a pattern has three entries,
    so the matrix is never built. Row 0 of the histogram is no length and weighs nothing.
    """
    n, scale = len(counts), max(1.0, float(counts.max()))
    aim = counts / scale
    weight = np.ones(n)
    weight[0] = 0.0

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(found[:, k], weights=x, minlength=n) for k in range(3)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[found[:, 0]] + r[found[:, 1]] + r[found[:, 2]]

    v = np.ones(len(found))
    for _ in range(20):                        # largest eigenvalue, for the step
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.05 * float(v @ back(apply(v))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(apply(y) - aim * weight), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups ``(lengths of a sequence, how many such sequences)`` that use up the histogram.

    Where long rows lack short ones to fill up with, exact patterns take the short ones from
    them. When a plan needs half a percent more sequences than the sum of lengths
    does, smaller shares of the fitted repeats are tried, and the shortest plan counts.
    """
    bound = sum(length * count for length, count in histogram.items()) / capacity
    plans = []
    for share in (1.0, 0.5, 0.0):
        plan = fitted_plan(histogram, capacity, share)
        plans.append((sum(times for _, times in plan), -share, plan))
        if plans[-1][0] <= 1.005 * bound + 1:
            break
    return min(plans, key=lambda p: p[:2])[2]


def fitted_plan(histogram: dict[int, int], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    """A plan that takes ``share`` of the fitted repeat counts and packs the rest best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        groups.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for _ in range(3 if share == 1 else int(share > 0)):      # fit again what rounding left
        lengths = np.flatnonzero(left)
        found = patterns(lengths, capacity) if len(lengths) else np.zeros((0, 3), int)
        if not len(found):
            break
        repeats = share * fit_repeats(found, left)
        before = len(groups)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 1:
                break
            parts = [int(p) for p in found[i] if p]
            times = min(int(repeats[i]), *(int(left[p]) // parts.count(p) for p in parts))
            if times > 0:
                groups.append((tuple(reversed(parts)), times))
                for p in parts:
                    left[p] -= times
        if len(groups) == before:
            break
    return groups + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for whole counts at a time."""
    open_: dict[int, list[list]] = {}          # space left -> [lengths, count] groups

    def put(space: int, lengths: tuple[int, ...], count: int) -> None:
        if count:
            open_.setdefault(space, []).append([lengths, count])

    for length in np.flatnonzero(left)[::-1]:
        length, rest = int(length), int(left[length])
        while rest:
            space = min((s for s in open_ if s >= length), default=None)
            if space is None:
                each = capacity // length
                put(capacity - each * length, (length,) * each, rest // each)
                put(capacity - rest % each * length, (length,) * (rest % each), int(rest % each > 0))
                break
            group = open_[space][-1]
            each = min(space // length, rest)
            bins = min(group[1], rest // each)
            put(space - each * length, group[0] + (length,) * each, bins)
            rest -= bins * each
            group[1] -= bins
            if not group[1]:
                open_[space].pop()
                if not open_[space]:
                    del open_[space]
    return [(lengths, count) for groups in open_.values() for lengths, count in groups]


def pack(rows: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give each of ``rows(length, ...)`` a sequence: adds ``sequence_id`` and ``offset``.

    Lengths lie between 1 and ``capacity``; other rows, null lengths too, are an error.
    ``keys`` order rows of one length; rows alike in them share a length's places in
    any order. No rows give no rows. The driver sees one count per length.
    """
    rows = settle(rows, "pieces")
    histogram = dict(rows.groupBy("length").count().collect())      # at most `capacity` rows
    if any(length is None or not 1 <= length <= capacity for length in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    places: list[tuple[int, int, int, int]] = []                     # length, first rank, sequence, offset
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for lengths, count in plan_packing(histogram, capacity):
        offset = 0
        for length in lengths:
            places.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 4)
    bits = max(int(table[:, 1].max()).bit_length() if len(table) else 0, 1)
    order = (table[:, 0] << bits) + table[:, 1]
    shift, first, sequences, offsets = bits, table[:, 1], table[:, 2], table[:, 3]

    ranked = hashed_rank(rows, ["length"], list(keys), "_rank")
    kept = [f.name for f in rows.schema.fields]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            own = np.minimum(rank, (1 << shift) - 1)
            i = np.searchsorted(order, (length << shift) + own, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(sequences[i] + rank - first[i], pa.int64()),
                 pa.array(offsets[i], pa.int64())], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "_rank").mapInArrow(place, f"{head}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
                   remembered: int = REMEMBERED) -> DataFrame:
    """Packed pieces with their checksum ``ids_crc32`` in place of the ids."""
    cut = pieces(docs, tokenizer_path, capacity, end_id, remembered)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
