import random

import numpy as np
import pytest
from conftest import FOLDER, ODD

from stylegraph.llm import near_dups
from stylegraph.llm.near_dups import Shingler, Signer, near_duplicates, one_of_each


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(width)])) if len(words) >= width else frozenset([tuple(words)])


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def brute(rows, width, percent):
    """Smallest id of each row's component, rows compared one by one; rows sorted by id."""
    sets = [shingles(t, width) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(rows[i][0], len(s), rows[r][0]) for i, (s, r) in enumerate(zip(sets, roots(len(rows), pairs)))]


def check(df, width, percent=80):
    rows = sorted((r.doc_id, r.text) for r in df.filter("doc_id is not null").select("doc_id", "text").collect())
    got = near_duplicates(df.filter("doc_id is not null"), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def variants(seed=0):
    """Groups of copies, chains of small changes, pairs just at and just below the threshold, short texts."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append(" ".join(text))
            if rng.random() < 0.7:
                text = text[:]
                for _ in range(rng.choice([1, 2, 9])):
                    text[rng.randrange(len(text))] = rng.choice(words)
    nine = [f"v{i}" for i in range(10)]                  # 9 shingles of two words
    rows += [" ".join(nine), " ".join(nine + ["x", "y"]), " ".join(nine + ["x", "y", "z"]), "A b", "a B", "ß", "SS"]
    rng.shuffle(rows)
    return [(i * 3, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(docs_of, width):
    check(docs_of(variants()), width)


def test_small_blocks_and_leaders(docs_of, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "SKETCH_BLOCK", 5)
    monkeypatch.setattr(near_dups, "CHUNK", 2)
    check(docs_of(variants(1), extra=False), 2)


def test_shuffled_ids(docs_of, monkeypatch):
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    check(docs_of(variants(2), extra=False), 2)


def test_table(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), 2)


def test_odd_rows(docs_of):
    rows = ODD + [(None, "same text here for all of us " * 20, "x"), (None, "nothing like it", "x")]
    got = near_duplicates(docs_of(rows), 2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} >= {
        (1, 1, True), (2, 2, True), (5, 5, True), (6, 5, False), (None, 5, False), (None, None, True), (7, 7, True)}
    assert near_duplicates(docs_of([])).count() == 0
    kept = one_of_each(docs_of(rows), 2)
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 5, 7, 8, None, None]))
    twice = docs_of([(1, "a b c", "x"), (1, "a b c", "x"), (2, "q r s", "x")])
    assert sorted(r.doc_id for r in one_of_each(twice, 2).collect()) == [1, 2]


def test_whole_sketches_travel_for_few_pairs(spark, monkeypatch):
    """Pairs of unrelated sets go by a few coordinates; pairs at the threshold stay."""
    rng = np.random.default_rng(3)
    nodes = [(i, rng.integers(0, 256, 300, np.uint8)) for i in range(60)]
    near = nodes[1][1].copy()
    near[rng.choice(300, 60, replace=False)] += 1            # 240 of 300 are equal
    frame = spark.createDataFrame([(i, s.tobytes()) for i, s in [*nodes, (60, near)]], "node bigint, sketch binary")
    pairs = spark.createDataFrame([(1, i) for i in range(61) if i != 1], "leader bigint, node bigint")
    asked, run = [], near_dups.equal_pairs
    monkeypatch.setattr(near_dups, "equal_pairs", lambda p, *a: asked.append(p.count()) or run(p, *a))
    assert [tuple(r) for r in near_dups.likely_pairs(pairs, frame, 80, 300).collect()] == [(1, 60)]
    assert asked == [60, 1]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = np.unique(items[:1200]), np.unique(items[300:])
    signer = Signer(256, 1)
    (x, y), (u, v) = signer([a, b])
    assert abs((x == y).mean() - 900 / 1500) < 0.12 and ((u == v) >= (x == y)).all()
    assert len(Shingler(5)("one two")) == 1 and len(Shingler(5)("a b c d e f")) == 2


def test_unrelated_long_texts_share_nothing():
    rng = np.random.default_rng(1)
    one, two = (np.unique(rng.integers(0, 1 << 63, 300_000).astype(np.uint64)) for _ in range(2))
    (keys, sketches) = Signer(50, 6)([one, two, one[:10], one])
    assert (sketches[0] == sketches[1]).sum() < 10 and not (keys[0] == keys[1]).any()
    assert (sketches[0] == sketches[3]).all() and (keys[0] == keys[3]).all()
    alone = Signer(50, 6)([one[:10]])
    assert (alone[0][0] == keys[2]).all() and (alone[1][0] == sketches[2]).all()


@pytest.mark.parametrize("n", [10, 40, 300])
def test_coordinates_spread_like_independent_ones(n):
    """Share of equal coordinates at similarity 0.8: mean and spread as with 300 independent ones."""
    rng, shares = np.random.default_rng(n), []
    for _ in range(200):
        items, cut = rng.integers(0, 1 << 63, n).astype(np.uint64), n // 10
        a, b = Signer(50, 6).lowest([np.sort(items[cut:]), np.sort(items[:n - cut])])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.006 and abs(np.std(shares) - 0.0231) < 0.006


def changed(rng, text, n):
    """``text`` with ``n`` words exchanged, far apart."""
    text = text[:]
    for at in range(n):
        text[at * len(text) // n] = f"new{rng.random()}"
    return text


def test_pairs_meet_their_leader_once(docs_of, monkeypatch):
    """A pair just below the threshold that is alone in its buckets is compared with a leader and not again in blocks."""
    rng, rows = random.Random(4), []
    for g in range(20):
        text = [f"{g}w{i}" for i in range(200)]
        rows += [" ".join(text), " ".join(changed(rng, text, 13))]       # 174 of 226 pairs of words: 0.77
    blocks, run = [], near_dups.verify_blocks
    monkeypatch.setattr(near_dups, "verify_blocks", lambda m, *a: blocks.append(m.count()) or run(m, *a))
    check(docs_of([(i, t, "s") for i, t in enumerate(rows)], extra=False), 2)
    assert sum(blocks) == 0


def test_signatures_travel_for_shared_buckets_only(docs_of, monkeypatch):
    """Sets that are alone in all buckets are not looked up; copies of one text count as one set, in either path."""
    rng, rows = random.Random(5), []
    for g in range(30):
        rows += [" ".join(f"{g}w{rng.randrange(10 ** 9)}" for _ in range(60))] * (g % 3 + 1)
    text = [f"v{i}" for i in range(300)]
    rows += [" ".join(text), " ".join(changed(rng, text, 3))]
    asked, run = [], near_dups.likely_pairs
    monkeypatch.setattr(near_dups, "likely_pairs", lambda p, nodes, *a: asked.append(nodes.count()) or run(p, nodes, *a))
    docs = docs_of([(i, t, "s") for i, t in enumerate(rows)], extra=False)
    check(docs, 2)
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    check(docs, 2)
    assert asked == [2, 2]


def test_wide_rows_stay_where_they_are(spark, monkeypatch):
    """Sets are shuffled for the comparison only, while what is looked up is small."""
    sets = spark.createDataFrame([(i, np.arange(9, dtype=np.uint64).tobytes()) for i in range(4)], "node bigint, items binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "leader bigint, node bigint")
    monkeypatch.setattr(near_dups, "settle", lambda df, label="": df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = near_dups.verify_stars(pairs, sets, 80)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2), (2, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(node" in line]
    assert plan.count("BroadcastHashJoin") == 1 and not shuffled
