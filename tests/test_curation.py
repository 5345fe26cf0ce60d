"""Vocabulary curation and selection against small brute-force versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.operators import contrast, curation as C, hooks as H


def brute_merge(edges, groups):
    alive, into = sorted(groups), {}
    while True:
        taken = {}
        for a in alive:
            if a in taken:
                continue
            for b in alive:
                if b > a and (a, b) in edges and b not in taken:
                    taken[b] = a
                    break
        if not taken:
            break
        into.update(taken)
        alive = [g for g in alive if g not in taken]

    def root(x):
        while x in into:
            x = into[x]
        return x

    return {x: root(x) for x in into}


@pytest.mark.parametrize("small", [200_000, 0])
def test_merge_rounds(spark, small):
    rng = np.random.default_rng(4)
    edges = {(a, b) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.2}
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    got = {r["group_idx"]: r["root"] for r in C.merge_groups(df, small).collect()}
    assert got == brute_merge(edges, range(14))


def test_differences_of_unlike_lengths(spark, monkeypatch):
    """Short features do not travel as long as the longest one, and all pairs are counted."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in [*rng.integers(0, 9, 60), 300, 600]]
    df = spark.createDataFrame(list(enumerate(texts)), "idx bigint, feature string")
    want = {}
    for x, y in itertools.combinations(texts, 2):
        want[word_diff(x, y)] = want.get(word_diff(x, y), 0) + 1
    widths, write = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df, label="table": widths.extend(df.selectExpr("size(vector) AS n").collect()) or write(df, label))
    monkeypatch.setattr(C, "TILE_ROWS", 16)
    assert {r["difference"]: r["pairs"] for r in C.word_difference_histogram(df).collect()} == want
    assert sorted(r["n"] for r in widths) == sorted(len(t.split()) for t in texts)


def test_merge_rounds_of_a_dense_group(spark, monkeypatch):
    """Claims that wait for each other cost no round of their own, and both paths agree."""
    rng = np.random.default_rng(7)
    edges = set(itertools.combinations(range(40), 2)) | {(100 + i, 101 + i) for i in range(30)} | {
        (200 + a, 200 + b) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.2}
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    want = {r["group_idx"]: r["root"] for r in C.merge_groups(df).collect()}
    written, write = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df, label="table": written.append(label) or write(df, label))
    assert {r["group_idx"]: r["root"] for r in C.merge_groups(df, 0).collect()} == want
    assert len(written) <= 2 + 3 * 8


def jaccard(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y)


def word_diff(a, b):
    return sum(x != y for x, y in itertools.zip_longest(a.split(), b.split()))


def brute_refine(features, eps, split, merge):
    n = len(features)
    near = {(i, j) for i in range(n) for j in range(n)
            if i != j and word_diff(features[i], features[j]) <= eps}
    clusters, seen = [], set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(n):
                if (x, y) in near and y not in group:
                    group.add(y)
                    todo.append(y)
        seen |= group
        if 1 < len(group) < 10:
            clusters.append(sorted(group))
    groups = []
    for g in clusters:
        alone = [x for x in g if sum(jaccard(features[x], features[y]) for y in g if y != x)
                 / (len(g) - 1) <= split]
        groups += [[x] for x in alone]
        rest = [x for x in g if x not in alone]
        if rest:
            groups.append(rest)
    edges = {(a, b) for a, b in itertools.combinations(range(len(groups)), 2)
             if jaccard(features[groups[a][0]], features[groups[b][0]]) >= merge}
    into = brute_merge(edges, range(len(groups)))
    return {features[x]: features[groups[into.get(i, i)][0]] for i, g in enumerate(groups) for x in g}


FEATURES = [
    "the author uses long words", "the author uses short words", "the author uses long lines",
    "words long uses author the", "words long uses the author", "the author is plain",
    "the author is plain and dry", "the author is very plain", "plain is the author",
    "plain is author the", "a b c d e f g h", "a b c d e f g i", "z", "quite another thing here",
    "quite another thing there", "never seen before in any text at all"]


def test_refine_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(FEATURES)), "idx bigint, feature string")
    for eps, split, merge in ((1, 0.5, 0.8), (2, 0.3, 0.6), (2, 0.7, 0.9)):
        got = {r["feature"]: r["canonical"] for r in C.refine_features(
            df, eps, split, merge).collect()}
        assert got == brute_refine(FEATURES, eps, split, merge)


def test_profile_metric_and_its_limit(spark):
    df = spark.createDataFrame(list(enumerate(FEATURES)), "idx bigint, feature string")
    d = np.array([[word_diff(a, b) for b in FEATURES] for a in FEATURES], float)
    e = np.round(np.sqrt(((d[:, None] - d[None]) ** 2).sum(2)), 9)
    near = (e <= 6).sum(1) > 1
    labels = {r["idx"]: r["cluster_label"] for r in C.word_clusters(df, 6.0, "profile").collect()}
    assert {i for i, x in labels.items() if x != -1} == set(np.nonzero(near)[0])
    with pytest.raises(ValueError):
        C.word_clusters(df, 6.0, "profile", max_features=3)


def test_profile_without_limit(spark):
    """More features than the former limit, and components equal to brute force over tasks of few rows."""
    rng = np.random.default_rng(5)
    texts = sorted({" ".join(rng.choice(list("abcdef"), rng.integers(1, 6))) for _ in range(150)})
    d = np.array([[word_diff(a, b) for b in texts] for a in texts], float)
    eps = 8.0
    near = np.round(np.sqrt(((d[:, None] - d[None]) ** 2).sum(2)), 9) <= eps
    label = np.arange(len(texts))
    for i, j in zip(*np.nonzero(near)):
        label[label == label[j]] = label[i]
    df = spark.createDataFrame(list(enumerate(texts)), "idx bigint, feature string")
    points = C.word_points(df)
    for size in (64 << 20, 2000):
        got = {r["id"]: r["cluster_label"] for r in
               C.labels_of(points, C.profile_edges(points, eps, size)).collect()}
        assert all((got[i] == -1) == ((label == label[i]).sum() == 1) for i in got)
        groups = {(got[i], label[i]) for i in got if got[i] != -1}
        assert len(groups) == len({g for g, _ in groups}) == len({c for _, c in groups}) > 1
    many = spark.range(20_003).select(F.col("id").alias("idx"), F.concat_ws(
        " ", F.lit("w"), F.greatest("id", F.lit(2))).alias("feature"))
    got = {r["idx"]: r["cluster_label"] for r in C.word_clusters(many, 1.0, "profile").collect()}
    assert len(got) == 20_003 and {i for i, x in got.items() if x != -1} == {0, 1, 2}


def test_overlap_edges_are_complete(spark):
    df = spark.createDataFrame(list(enumerate(FEATURES)), "id bigint, text string")
    for t in (0.3, 0.6, 0.8, 1.0):
        got = {(r["a"], r["b"]) for r in C.overlap_edges(df, t).collect()}
        assert got == {(a, b) for a, b in itertools.combinations(range(len(FEATURES)), 2)
                       if jaccard(FEATURES[a], FEATURES[b]) >= t}


def test_second_round_lookup(spark):
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(FEATURES)], "pos bigint, f string")
    both = C.canonical_features(rows, "f", ["pos"], True, eps=1, split_threshold=0.3,
                                merge_threshold=0.6)
    last = C.canonical_features(rows, "f", ["pos"], False, eps=1, split_threshold=0.3,
                                merge_threshold=0.6)
    first = brute_refine(FEATURES, 1, 0.3, 0.6)
    names = list(dict.fromkeys(first.get(f, f) for f in FEATURES))
    second = brute_refine(names, 1, 0.3, 0.6)
    assert {r["f"]: r["aggregated_name"] for r in both.collect()} == {
        f: second.get(first.get(f, f), first.get(f, f)) for f in FEATURES}
    assert {r["f"]: r["aggregated_name"] for r in last.collect()} == {
        f: second.get(f, f) for f in FEATURES}


def mmd(k, chosen, universe):
    return 2 * k[np.ix_(universe, chosen)].mean(0).mean() - k[np.ix_(chosen, chosen)].mean()


def test_greedy_maximises_the_gain(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(40, 5))
    y = np.array([i % 3 for i in range(40)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    k = m @ m.T
    items = spark.createDataFrame(
        [(i, int(y[i]), [float(x) for x in m[i]]) for i in range(40)],
        "id bigint, class bigint, vector array<double>")
    got = {}
    for r in contrast.greedy_select_by_class(items, 4, 0.1).collect():
        got.setdefault(r["class"], {})[r["step"]] = (r["id"], r["gain"])

    def gain(s, chosen, universe):
        # the closed form of the normalised MMD gain, over explicit kernel entries
        n = len(chosen) + 1
        value = 2 * k[universe, s].mean() - k[s, s] / n
        if n > 1:
            value += (-2 * k[np.ix_(universe, chosen)].mean(0).mean()
                      + (2 * (n - 1) / n + 1 / n) * k[np.ix_(chosen, chosen)].mean()
                      - 2 * (n - 1) / n * k[chosen, s].mean())
        return value / n

    for c in range(3):
        inside, outside = np.nonzero(y == c)[0], np.nonzero(y != c)[0]
        chosen = []
        for step in range(1, 5):
            best = min((s for s in inside if s not in chosen),
                       key=lambda s: (-round(gain(s, chosen, inside) - 0.1 * gain(s, chosen, outside), 12), s))
            assert got[c][step][0] == best
            chosen.append(int(best))


def test_logdet_with_several_selected(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(12, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                  "id bigint, vector array<double>")
    s, p = items.filter("id in (0, 1)").select("id"), items.filter("id = 2").select("id")
    got = {r["id"]: r["gain"] for r in contrast.gain_logdet(items, s, p).collect()}
    k = m @ m.T
    for i in range(3, 12):
        whole, part = [0, 1, 2, i], [0, 1, 2]
        want = np.log(np.linalg.det(k[np.ix_(whole, whole)]) / np.linalg.det(k[np.ix_(part, part)]))
        assert got[i] == pytest.approx(want, abs=1e-8)


def test_generation_is_not_repeated(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "text string")
    done = spark.createDataFrame([("say", "a", "old")], "instruction string, input string, generations string")

    def fail_on_a(instruction, text):
        assert text not in ("", "a")
        return f"{instruction} {text}"

    got = sorted(r["generations"] for r in H.ask(rows, "say", F.col("text"), fail_on_a, done).collect())
    assert got == ["", "old", "old", "say b"]


def test_custom_encoder(spark):
    rows = spark.createDataFrame([("ab",), ("abc",)], "text string")
    out = H.encode_documents(rows, "text", lambda: (lambda texts: [[len(t), 1.0] for t in texts]))
    assert {r["text"]: r["embedding"] for r in out.collect()} == {"ab": [2.0, 1.0], "abc": [3.0, 1.0]}
