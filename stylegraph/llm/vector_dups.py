"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codes are the
cells of a product grid. A vector lies in the cell of its nearest codes and visits
cells in the order of its distance to them (the two sorted lists of code distances are
walked together) until the target share of neighbours at the threshold must have
been met; the bound of the walk is measured on vectors moved to the very threshold.
What it meets is verified by the cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.llm.common import only, stable_hash
from stylegraph.operators.graph import connected_components
from stylegraph.operators.skew import lookup_join
from stylegraph.sources.staging import settle

#: Vectors the codebooks and the bound of the walk are fitted on, those with the smallest hashes.
SAMPLE = 16_384
#: Rows of one side of a comparison in a task.
CHUNK = 1024


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each code."""
    return np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1) - 2 * x @ codes.T, 0.0)


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means; an empty code moves to a random row."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, codes).argmin(1)
        n = np.bincount(own, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(codes))])
    return codes


class MultiIndex:
    """Two codebooks and the bound of the walk, for unit vectors of one width."""

    def __init__(self, sample: np.ndarray, threshold: float, recall: float, size: int, seed: int = 0):
        self.cut = max(1, sample.shape[1] // 2)
        self.codes = [codebook(sample[:, :self.cut], size, seed=seed),
                      codebook(sample[:, self.cut:], size, seed=seed + 1)]
        # neighbours exactly at the threshold: the farthest that still count
        rng = np.random.default_rng(seed + 2)
        x = sample[rng.choice(len(sample), min(4096, len(sample)), replace=False)]
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        q = threshold * x + np.sqrt(1 - threshold ** 2) * aside
        cell = [nearest(h, c).argmin(1) for h, c in zip(self.halves(x), self.codes)]
        own = self.distances(q)
        rows = np.arange(len(x))
        excess = sum(d[rows, c] - d.min(1) for d, c in zip(own, cell))
        self.bound = float(np.quantile(excess, recall)) * (1 + 1e-9) + 1e-12

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [nearest(h, c) for h, c in zip(self.halves(x), self.codes)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row, one number."""
        first, second = (d.argmin(1) for d in self.distances(x))
        return first * len(self.codes[1]) + second

    def walk(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells in the order of the sum of two lists of distances, up to the bound."""
        i_order, j_order = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        limit = first[i_order[0]] + second[j_order[0]] + self.bound
        seen, out = {(0, 0)}, []
        heap = [(first[i_order[0]] + second[j_order[0]], 0, 0)]
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > limit:
                break
            out.append(int(i_order[i]) * len(self.codes[1]) + int(j_order[j]))
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(first) and b < len(second) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (first[i_order[a]] + second[j_order[b]], a, b))
        return out

    def visits(self, x: np.ndarray) -> list[list[int]]:
        first, second = self.distances(x)
        return [self.walk(a, b) for a, b in zip(first, second)]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, unit, node`` of ``vectors(vec_id, embedding, label)``.

    ``unit`` is null where the vector is null, zero or not finite or the label is null.
    ``node`` names equal vectors of one label.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("unit", pa.list_(pa.float64())),
                        ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            units, nodes = [], []
            for vector, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                unit = node = None
                if vector and label is not None and None not in vector:
                    v = np.array(vector, np.float64)
                    largest = np.abs(v).max()
                    if np.isfinite(largest) and largest > 0:
                        v = v / largest          # no overflow in the squares
                        unit = v / np.sqrt((v * v).sum())
                        raw = f"{label}:".encode() + (v + 0.0).tobytes()
                        node = int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))
                units.append(unit)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array(units, schema.field("unit").type),
                pa.array(nodes, pa.int64())], schema=schema)

    return only(vectors, vec_id="bigint", label="string", embedding="array<double>").mapInArrow(
        run, "vec_id bigint, label string, unit array<double>, node bigint")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def codebook_size(rows: int) -> int:
    """Codes per half: cells hold some dozens of rows, so the grid grows with the table."""
    return int(np.clip(np.sqrt(rows / 32), 8, 1024))


def vector_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.995,
                      sample: int = SAMPLE) -> DataFrame:
    """Links of cosine at least ``threshold`` between vectors of one label, and their components.

    Returns ``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id,
    embedding, label)``. Rows without a label or with a null, empty, zero or not
    finite vector link with nothing; so do vectors of different widths. Equal
    vectors of one label are one node with a count and always linked. Ids may repeat; null ids
    never name a component and keep their row if it has no named one. No rows give no rows.
    A pair is looked for once, from the vector with the smaller node number.
    """
    units = settle(unit_vectors(vectors), "units")
    nodes = settle(units.filter("node is not null").groupBy("node", "label").agg(
        F.first("unit").alias("unit"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("width", F.size("unit")), "nodes")
    found, links = None, None
    # one index per width of vectors; as a rule there is one
    for width, rows in sorted(nodes.groupBy("width").count().collect()):
        chosen = nodes.filter(F.col("width") == width)
        fitted = _matrix(chosen.select("node", "unit", stable_hash(F.col("node")).alias("_h"))
                         .orderBy("_h", "node").limit(sample).toArrow().column("unit"))
        index = MultiIndex(fitted, threshold, recall, codebook_size(rows))
        made = settle(search(chosen, index, threshold), "links")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return units.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                            F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    groups = connected_components(found.filter("edge").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.filter("not edge").groupBy("node").agg(F.sum("links").alias("_links"))
    named = settle(nodes.select("node", "id", "copies").join(counts, "node", "left").join(
        groups, "node", "left").select(
        "node", "id", "copies", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    per_node = lookup_join(named.select("node", "copies", "n_links", "component"), smallest, ["component"],
                           counted="_n").select("node", "copies", "n_links", "component_id")
    linked = lookup_join(units.filter("node is not null").select("vec_id", "node"), per_node, ["node"],
                         counted="copies").select("vec_id", "n_links", "component_id")
    alone = units.filter("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                                F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def search(nodes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """Verified links of ``nodes(node, label, unit, copies)``: ``node, other, links, edge``.

    Rows with ``edge`` form a spanning forest of the links met in a task; the others say
    how many vectors a node is linked with. A node travels once to each first code it
    visits, with the second codes; there it meets the rows of that first code. Both
    sides of a crowded first code are dealt into chunks of about ``CHUNK`` rows.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    second = len(index.codes[1])
    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("copies", pa.int64()),
                        ("unit", pa.list_(pa.float64())), ("first", pa.int32()), ("home", pa.int32()),
                        ("seconds", pa.list_(pa.int32()))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("unit"))
                cells, take, first, home, seconds = own.cells(x), [], [], [], []
                for r, visited in enumerate(own.visits(x)):
                    by_first: dict[int, list[int]] = {}
                    for cell in visited:
                        by_first.setdefault(cell // second, []).append(cell % second)
                    for f, s in by_first.items():
                        take.append(r)
                        first.append(f)
                        home.append(int(cells[r]) % second if f == cells[r] // second else -1)
                        seconds.append(s)
                rows = part.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in ("node", "label", "copies", "unit")], pa.array(first, pa.int32()),
                    pa.array(home, pa.int32()), pa.array(seconds, schema.field("seconds").type)], schema=schema)

    visits = settle(nodes.select("node", "label", "copies", "unit").mapInArrow(
        visit, "node bigint, label string, copies bigint, unit array<double>, first int, home int, "
               "seconds array<int>"), "visits")
    # `home` >= 0: the row lives here (its nearest cell is always visited)
    sizes = visits.groupBy("label", "first").agg(F.count(F.lit(1)).alias("_n"), F.count(
        F.when(F.col("home") >= 0, 1)).alias("_m")).filter("_m > 0")
    dealt = lookup_join(visits, sizes, ["label", "first"], counted="_n").select(
        *visits.columns, F.ceil(F.col("_n") / CHUNK).cast("int").alias("_q"),
        F.ceil(F.col("_m") / CHUNK).cast("int").alias("_r"), F.xxhash64("node").alias("_h"))
    asking = dealt.withColumn("i", F.pmod("_h", "_q").cast("int")).withColumn(
        "j", F.explode(F.expr("sequence(0, _r - 1)"))).withColumn("asks", F.lit(True))
    living = dealt.filter("home >= 0").withColumn("j", F.pmod("_h", "_r").cast("int")).withColumn(
        "i", F.explode(F.expr("sequence(0, _q - 1)"))).withColumn("asks", F.lit(False))
    columns = ["label", "first", "i", "j", "asks", "node", "copies", "unit", "home", "seconds"]
    out = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("edge", pa.bool_())])

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        unit, home = _matrix(table.column("unit")), table.column("home").to_numpy()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a) or not len(b):
            return out.empty_table()
        visited = np.zeros((len(a), second), bool)
        lists = table.column("seconds").to_pylist()
        for r, i in enumerate(a):
            visited[r, lists[i]] = True
        hit = (unit[a] @ unit[b].T >= threshold) & visited[:, home[b]] & (node[a][:, None] < node[b][None, :])
        to_a, to_b = hit @ copies[b], copies[a] @ hit
        nodes_, others, links, edge = [], [], [], []
        for ids, sums in ((node[a], to_a), (node[b], to_b)):
            some = sums > 0
            nodes_.append(ids[some])
            others.append(ids[some])
            links.append(sums[some])
            edge.append(np.zeros(int(some.sum()), bool))
        x, y = forest(hit)
        nodes_.append(node[a][x])
        others.append(node[b][y])
        links.append(np.zeros(len(x), np.int64))
        edge.append(np.ones(len(x), bool))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(
            (nodes_, others, links, edge), out.types)], schema=out)

    return asking.select(columns).unionByName(living.select(columns)).groupBy(
        "label", "first", "i", "j").applyInArrow(compare, "node bigint, other bigint, links bigint, edge boolean")


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the bipartite graph ``hit``."""
    left, right = hit.any(1), hit.any(0)
    waiting_l, waiting_r = left.copy(), right.copy()
    xs, ys = [], []
    for start in np.flatnonzero(left):
        if not waiting_l[start]:
            continue
        waiting_l[start] = False
        queue = [(start, True)]
        while queue:
            at, is_left = queue.pop()
            if is_left:
                new = np.flatnonzero(hit[at] & waiting_r)
                waiting_r[new] = False
                xs.extend([at] * len(new))
                ys.extend(new)
            else:
                new = np.flatnonzero(hit[:, at] & waiting_l)
                waiting_l[new] = False
                xs.extend(new)
                ys.extend([at] * len(new))
            queue.extend((n, not is_left) for n in new)
    return np.array(xs, np.int64), np.array(ys, np.int64)
