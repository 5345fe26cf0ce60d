"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations of the 32-bit numbers make all coordinates of a signature: the first
scatters the hashed shingles, the second, shifted circularly by k, is
minimised for coordinate k. Both are computed, not stored, so that the universe is far larger than
the longest text and unrelated long texts share no coordinates. Documents that agree in all rows of a band meet in a
bucket. Only connectivity is asked for, so a bucket is first compared with single
leaders, round by round; only what then still lies in different components
is compared pair by pair, in bounded blocks. The share of equal coordinates rules out
pairs far below the threshold before full shingle sets travel; every link is
confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.llm.common import only
from stylegraph.operators.graph import connected_components
from stylegraph.operators.skew import lookup_join
from stylegraph.sources.staging import settle

#: Odd multipliers of the two permutations; shingles signed in one go, so that they stay in a core's cache.
FIRST, SECOND, CACHED = 0x9E3779B1, 0x85EBCA6B, 16_384
#: Sets compared with a leader by one task; sets, and sketches, of one side of a block.
CHUNK, BLOCK, SKETCH_BLOCK = 128, 64, 512
#: Standard errors below the threshold at which the share of equal coordinates rules a pair out.
ERRORS = 5.5
#: Rounds of leaders before blocks, and ids that are broadcast at most (about 64 MB).
LEADER_ROUNDS, BROADCAST_IDS = 3, 2_000_000
#: Coordinates of a sketch that rule most pairs out before whole sketches travel.
BRIEF = 64
#: Words a worker remembers; shingles signed at a time.
REMEMBERED, SIGNED = 100_000, 250_000
_mask = np.uint64((1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct hashed word shingles of whole texts."""

    def __init__(self, words: int):
        self.width, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash
        # bytes: lower() changes A-Z only, split() cuts at ASCII white space only
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        codes = [known.get(w) for w in words]
        if None in codes:
            digest = xxhash.xxh64_intdigest
            for i, c in enumerate(codes):
                if c is None:
                    codes[i] = known[words[i]] = digest(words[i])
        h = np.array(codes, np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = mix(h[:n] + np.uint64(width))
        for k in range(1, width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
        return np.unique(out)


class Signer:
    """Signatures of sets: ``bands * rows`` coordinates, hashed band by band, and a byte of each as a sketch.

    The first permutation is ``x * FIRST``, the second folds the upper half of a number into the
    lower one and multiplies by ``SECOND``, all modulo 2^32. The shift runs on the circle of products:
    coordinate k minimises the second permutation at ``(x + k) * FIRST``.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows

    def lowest(self, sets: list[np.ndarray]) -> np.ndarray:
        """The coordinates of each of the non-empty ``sets``."""
        at = np.concatenate(sets)
        at = (at ^ (at >> np.uint64(32))).astype(np.uint32) * np.uint32(FIRST)
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        out = np.empty((len(sets), self.bands * self.rows), np.uint32)
        moved, upper = np.empty_like(at), np.empty_like(at)
        for k in range(out.shape[1]):
            np.add(at, np.uint32(k * FIRST & 0xFFFFFFFF), out=moved)
            np.right_shift(moved, np.uint32(16), out=upper)
            np.bitwise_xor(moved, upper, out=moved)
            np.multiply(moved, np.uint32(SECOND), out=moved)
            out[:, k] = np.minimum.reduceat(moved, starts)
        return out

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One row of band hashes and one of bytes per non-empty set."""
        done, ends = [], np.cumsum([*map(len, sets)])
        first = 0
        while first < len(sets):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CACHED, "right")))
            done.append(self.lowest(sets[first:last]))
            first = last
        lowest = np.concatenate(done)
        out = np.empty((len(sets), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(sets), band, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + lowest[:, k].astype(np.uint64))
            out[:, band] = key
        return out.view(np.int64), (lowest & 255).astype(np.uint8)


def least_equal(percent: int, coordinates: int) -> int:
    """Equal coordinates that a pair at the threshold has but with a negligible probability."""
    share = percent / 100
    return int(coordinates * share - ERRORS * np.sqrt(coordinates * share * (1 - share)))


def node_of(shingles: np.ndarray) -> int:
    """Identity of a set, 64 bits; equal sets are one node."""
    import xxhash
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, node, keys, sketch`` of each whole text; without words the last three are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(bands, rows)

        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys, sketches = map(iter, signer(full)) if full else (iter(()), iter(()))
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([next(keys) if len(s) else None for s in sets], schema.field("keys").type),
                pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)

        for batch in batches:
            ids, sets, n = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                sets.append(shingler(text.as_py()))
                n += len(sets[-1])
                if n >= SIGNED:
                    yield flush(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield flush(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``node, items``: the sorted hashed shingles of each text as bytes."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingler(t.as_py()) for t in batch.column("text").slice(at, 512)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, "node bigint, items binary")


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted ``others`` have a Jaccard similarity of at least ``percent`` to ``one``."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), np.uint64) for v in table.column("items")]


def fits(table: DataFrame, share: int = 1) -> bool:
    """Whether a written table may travel with the tasks; rows of several columns get a ``share``-th of the ids."""
    return table.count() * share <= BROADCAST_IDS


def with_sets(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """``tasks(node, ...)`` with the sets of their nodes; while they fit, tasks travel to the sets."""
    tasks = settle(tasks, "tasks")
    return sets.join(F.broadcast(tasks) if fits(tasks, 3) else tasks, "node")


_edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges among ``pairs(leader, node)``: each task compares one leader with at most ``CHUNK`` sets or so."""
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("_n"))
    dealt = settle(lookup_join(pairs, sizes, ["leader"], counted="_n").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / CHUNK).cast("bigint"))).drop("_n"), "stars")
    # leaders and members take their sets by one join, so that the sets are shuffled once at most
    heads = dealt.select("leader", "chunk", F.col("leader").alias("node")).distinct()
    tasks = with_sets(dealt.select("leader", "chunk", "node").unionByName(heads), sets).select(
        "leader", "chunk", "node", "items")

    def compare(table: pa.Table) -> pa.Table:
        head = table.column("leader")[0].as_py()
        nodes, found = table.column("node").to_numpy(), _sets(table)
        one = next((s for s, n in zip(found, nodes) if n == head), None)
        rest = [i for i, n in enumerate(nodes) if n != head]
        if one is None or not rest:
            return _edges.empty_table()
        good = alike(one, [found[i] for i in rest], percent)
        ends = nodes[rest][good]
        return pa.table([pa.array(np.full(len(ends), head), pa.int64()), pa.array(ends, pa.int64())], schema=_edges)

    return tasks.groupBy("leader", "chunk").applyInArrow(compare, "a bigint, b bigint")


def sketches_of(table: pa.Table, column: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(table.num_rows, -1)


def equal_pairs(pairs: DataFrame, nodes: DataFrame, sketch: Column, least: int) -> DataFrame:
    """The ``pairs(leader, node)`` with at least ``least`` equal bytes in ``sketch``, a column of ``nodes``."""
    sketches = nodes.select("node", sketch.alias("sketch"))
    both = pairs.join(sketches, "node").join(sketches.select(
        F.col("node").alias("leader"), F.col("sketch").alias("other")), "leader").select(
        "leader", "node", "sketch", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                equal = (sketches_of(table) == sketches_of(table, "other")).sum(1)
                yield batch.select(["leader", "node"]).filter(pa.array(equal >= least))

    return both.mapInArrow(run, "leader bigint, node bigint")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """The ``pairs(leader, node)`` with as many equal coordinates as a pair at the threshold has.

    Most pairs of unrelated texts go by the first ``BRIEF`` coordinates, so whole sketches travel for few.
    """
    if coordinates > BRIEF:
        pairs = equal_pairs(pairs, nodes, F.substring("sketch", 1, BRIEF), least_equal(percent, BRIEF))
    return equal_pairs(pairs, nodes, F.col("sketch"), least_equal(percent, coordinates))


def block_tasks(members: DataFrame, block: int) -> DataFrame:
    """Deals each bucket of ``members(key, node, n, component)`` into tasks ``(key, i, j)``.

    A bucket falls into chunks of about ``block`` rows, a task gets two chunks (``chunk`` tells a row's
    own). In a large bucket the rows of its largest component meet only the others.
    """
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("_n", "component")).alias("_m"), F.sum("_n").alias("_n")).select(
        "key", "_n", F.when(F.col("_n") > block, F.col("_m.component")).alias("_main"),
        F.when(F.col("_n") > block, F.col("_m._n")).otherwise(0).alias("_size"))
    chunks = lambda n: F.ceil(n / block).cast("int")
    dealt = (lookup_join(members, sizes, ["key"], counted="_n")
             .withColumn("_most", F.col("component").eqNullSafe(F.col("_main")))
             .withColumn("_few", chunks(F.col("_n") - F.col("_size"))).withColumn("_many", chunks(F.col("_size")))
             .withColumn("_x", F.when(F.col("_most"), F.col("_few") + F.pmod(F.xxhash64("node"), F.col("_many")))
                         .otherwise(F.pmod(F.xxhash64("node"), F.col("_few"))).cast("int"))
             .withColumn("_last", F.when(F.col("_most"), F.col("_few") - 1).otherwise(F.col("_few") + F.col("_many") - 1)))
    tasks = dealt.select("key", "node", "n", "component", "_x", F.explode(F.expr("sequence(0, _last)")).alias("_y"))
    return tasks.select("key", F.least("_x", "_y").alias("i"), F.greatest("_x", "_y").alias("j"),
                        "node", "n", "component", F.col("_x").alias("chunk"))


def likely_members(members: DataFrame, nodes: DataFrame, percent: int, least: int) -> DataFrame:
    """The rows of ``members(key, node, n, component)`` that may be linked across components in their bucket.

    A pair counts in the first bucket that it shares, so later steps meet it once.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        nodes, groups = table.column("node").to_numpy(), table.column("component").to_numpy()
        chunk, i, j = table.column("chunk").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key, sizes = table.column("key")[0].as_py(), table.column("n").to_numpy()
        sketch = sketches_of(table)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        likely = np.zeros(len(nodes), bool)
        for x in np.flatnonzero(chunk == i):
            rest = np.flatnonzero((groups != groups[x]) & (chunk == j) & (
                100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
            rest = rest[(sketch[rest] == sketch[x]).sum(1) >= least]
            if len(rest):
                first = (keys[rest] == keys[x]).argmax(1)
                rest = rest[keys[x][first] == key]
                likely[rest] = True
                likely[x] |= len(rest) > 0
        return pa.table([pa.array(np.full(int(likely.sum()), key), pa.int64()), pa.array(nodes[likely], pa.int64())],
                        schema=schema)

    marked = block_tasks(members, SKETCH_BLOCK).join(nodes.select("node", "sketch", "keys"), "node").groupBy(
        "key", "i", "j").applyInArrow(compare, "key bigint, node bigint")
    return members.join(settle(marked.distinct(), "likely"), ["key", "node"], "left_semi")


def verify_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between different components inside each bucket of ``members(key, node, n, component)``."""
    tasks = block_tasks(members, BLOCK).drop("n")

    def compare(table: pa.Table) -> pa.Table:
        nodes, groups = table.column("node").to_numpy(), table.column("component").to_numpy()
        chunk, i, j = table.column("chunk").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = _sets(table)
        sizes = np.array([len(s) for s in found])
        a, b = [], []
        for x in range(len(nodes)):
            if chunk[x] != i:
                continue
            other = (groups != groups[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            other &= (nodes > nodes[x]) if i == j else (chunk == j)
            rest = np.flatnonzero(other)
            if len(rest):
                good = rest[alike(found[x], [found[r] for r in rest], percent)]
                a.extend([nodes[x]] * len(good))
                b.extend(nodes[good])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_edges)

    return with_sets(tasks, sets).groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def with_leaders(members: DataFrame, turn: int) -> DataFrame:
    """``members(key, node, n, component)`` with one leader per bucket: ``leader, leader_n, leader_component``."""
    leaders = members.groupBy("key").agg(F.min(F.struct(
        F.xxhash64(F.col("node"), F.lit(turn)).alias("h"), F.col("node").alias("leader"),
        F.col("n").alias("leader_n"), F.col("component").alias("leader_component"))).alias("_l"),
        F.count(F.lit(1)).alias("_n")).select("key", "_l.leader", "_l.leader_n", "_l.leader_component", "_n")
    return lookup_join(members, leaders, ["key"], counted="_n").drop("_n")


def to_leaders(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(leader, node)`` of each leader with its bucket's members in other components, sizes permitting."""
    return (dealt.filter("component <> leader_component and "
                         f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)")
            .select("leader", "node").distinct())


def one_row_each(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``signed(row, node, ...)`` that stand for their node: ``row`` of ``nodes(node, row, copies)``.

    Only the rows that go are looked up, so that signatures are not shuffled while copies are few.
    """
    several = nodes.filter("copies > 1").select("node", F.col("row").alias("_first"), "copies")
    spare = settle(lookup_join(signed.select("node", "row"), several, ["node"], counted="copies")
                   .filter("row <> _first").select("row"), "spare")
    full = signed.filter("node is not null")
    if fits(spare):
        return full.join(F.broadcast(spare), "row", "left_anti")
    return settle(full.join(spare, "row", "left_anti"), "first")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50,
                    rows: int = 6) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent``.

    Texts are lower-cased in A-Z and cut at ASCII white space. Returns one row per row
    of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``. A text without
    words, null too, has an empty set and links with nothing. A text with fewer
    than ``words`` words has its whole sequence as the only shingle. Rows with equal sets are one
    node. Ids may repeat; a null id never names a component, and a component
    without ids has a null ``component_id`` and keeps its rows. No rows give no rows.

    A very long text is one set like any other, held whole by the task that signs it.

    With 50 bands of 6 rows a pair at similarity 0.8 meets in some bucket but for
    3e-7; below, chances fall (0.5: 0.54, 0.2: 0.003), so that buckets do not fill up with
    unrelated texts as a table grows. Equal coordinates rule it out with less than 1e-6. Shingles and sets are
    told apart by 64-bit hashes.
    """
    docs = only(docs, doc_id="bigint", text="string")
    signed = settle(signatures(docs, words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = settle(signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.min("row").alias("row"),
        F.count(F.lit(1)).alias("copies")), "nodes")
    first = one_row_each(signed, nodes)
    least = least_equal(percent, bands * rows)
    members = first.select("node", F.explode("keys").alias("key"))
    crowded = settle(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "crowded")
    buckets = settle(members.join(F.broadcast(crowded.select("key")), "key") if fits(crowded)
                     else lookup_join(members, crowded, ["key"], counted="_n").drop("_n"), "buckets")

    # most sets are alone in their buckets: signatures and texts are read again for the others only
    wanted = settle(buckets.select("node").distinct().join(nodes.select("node", "n", "id"), "node"), "wanted")
    few = F.broadcast if fits(wanted) else lambda df: df
    sketches = settle(first.select("node", "keys", "sketch").join(few(wanted.select("node")), "node", "left_semi"), "sketches")
    ids = few(wanted.select(F.col("id").alias("_id")))
    sets = settle(shingle_sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), words), "sets")

    open_ = buckets.join(few(wanted.select("node", "n")), "node").withColumn("component", F.col("node"))
    open_ = settle(open_.select("key", "node", "n", "component"), "open")
    edges, found, rest = None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        last = False
        if turn:
            # a bucket inside one component stays so: only the open ones go on
            joined = lookup_join(rest, found.withColumnRenamed("component", "_c"), ["node"], "left")
            joined = joined.select("key", "node", "n", F.coalesce("_c", "node").alias("component"))
            mixed = settle(joined.groupBy("key").agg(
                F.min("component").alias("_a"), F.max("component").alias("_b"),
                F.count(F.lit(1)).alias("_n")).filter("_a < _b").select("key", "_n"), "mixed")
            largest = mixed.agg(F.max("_n")).first()[0]
            if largest is None:
                break
            open_ = settle(lookup_join(joined, mixed, ["key"], counted="_n").drop("_n"), "open")
            last = largest <= SKETCH_BLOCK or turn == LEADER_ROUNDS      # leaders pay off in large buckets only
        if last:
            new = verify_blocks(settle(likely_members(open_, sketches, percent, least), "likely"), sets, percent)
        else:
            dealt = settle(with_leaders(open_, turn), "dealt")
            new = verify_stars(settle(likely_pairs(to_leaders(dealt, percent), sketches, percent, bands * rows), "pairs"),
                               sets, percent)
            # all pairs of a leader in its bucket are settled now
            rest = dealt.filter("node <> leader").select("key", "node", "n")
        new = settle(new, "edges")
        edges = new if edges is None else edges.unionByName(new)
        found = connected_components(edges)
        if last:
            break

    named = lookup_join(nodes.select("node", "id", "copies"), found.withColumnRenamed("component", "_c"), ["node"], "left")
    named = settle(named.select("node", "id", "copies", F.coalesce("_c", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    per_node = lookup_join(named.select("node", "component", "copies"), smallest, ["component"], counted="_n").select(
        "node", "component_id", F.col("copies").alias("_n"))
    full = lookup_join(signed.filter("node is not null").select("doc_id", "n_shingles", "node"), per_node,
                       ["node"], counted="_n").select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the smallest id.

    Rows that repeat id and text count as one; rows without an id stay. Rows that go
    are found by their ids, which travel with the tasks while they fit and are
    joined by a shuffle beyond ``BROADCAST_IDS``.
    """
    found = settle(near_duplicates(docs, words, percent), "judged")
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("kept").cast("int")).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    ids = settle(ids.filter("_kept = 0 or _n > 1").withColumnRenamed("doc_id", "_id"), "marked")

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    same = F.col("doc_id") == F.col("_id")
    rest = docs.join(sized(ids.filter("_kept = 0").select("_id")), same, "left_anti")
    again = ids.filter("_kept = 1").select("_id")
    if again.isEmpty():
        return rest
    again = sized(again)
    return rest.join(again, same, "left_anti").unionByName(
        rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
