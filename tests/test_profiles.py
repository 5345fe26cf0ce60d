"""Near rows of the word difference matrix against the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylegraph.operators import curation as C, profiles as P


def matrix(texts):
    def apart(a, b):
        a, b = a.split(), b.split()
        return max(len(a), len(b)) - sum(x == y for x, y in zip(a, b))
    d = np.array([[apart(a, b) for b in texts] for a in texts], float)
    return ((d[:, None] - d[None]) ** 2).sum(2)


@pytest.mark.parametrize("frequent, lengths", [(1024, 256), (3, 4)])
def test_few_pairs_are_summed_up_and_rightly(spark, monkeypatch, frequent, lengths):
    monkeypatch.setattr(P, "FREQUENT", frequent)
    monkeypatch.setattr(P, "LENGTHS", lengths)
    asked, sums = [], P.profile_distances

    def seen(pairs, *rest):
        asked.extend((r["a"], r["b"], int(r["square"])) for r in sums(pairs, *rest).collect())
        return sums(pairs, *rest)

    monkeypatch.setattr(P, "profile_distances", seen)
    rng = np.random.default_rng(7)
    texts = sorted({" ".join(["so"] * int(rng.integers(0, 2)) + [w + ("often" if rng.random() < 0.3 else "") for w in rng.choice(
        list("abcdefghij"), rng.integers(1, 7))] + [f"w{rng.integers(0, 60)}"]) for _ in range(220)})
    square = matrix(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "idx bigint, feature string")
    for eps in (2.0, 7.0):
        asked.clear()
        edges = [(r["a"], r["b"]) for r in P.profile_edges(C.word_points(df), eps, 64).collect()]
        assert all(square[a, b] == s for a, b, s in asked)
        label, want = np.arange(len(texts)), np.arange(len(texts))
        for a, b in edges:
            label[label == label[b]] = label[a]
        for a, b in zip(*np.nonzero(square <= eps * eps)):
            want[want == want[b]] = want[a]
        pairs = {*zip(label.tolist(), want.tolist())}
        assert len(pairs) == len({*label.tolist()}) == len({*want.tolist()})
        assert len(asked) < len(texts) ** 2 / 8


def test_features_without_words(spark):
    df = spark.createDataFrame([(0, ""), (1, " "), (2, None), (3, "a b c d e f g h i")], "idx bigint, feature string")
    got = {r["idx"]: r["cluster_label"] for r in C.word_clusters(df, 1.0, "profile").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1}
    none = C.word_clusters(df.filter(F.lit(False)), 1.0, "profile")
    assert none.columns == ["idx", "cluster_label"] and none.isEmpty()
