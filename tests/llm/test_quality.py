import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import FOLDER, ODD

from stylegraph.llm.quality_rules import keep_good, quality_rules
from stylegraph.llm.queries import QUERIES
from stylegraph.llm import subwords
from stylegraph.llm.subwords import fit_quality, score_quality
from stylegraph.llm.trees import fit

LABELS = "doc_id bigint, quality int, toxic int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def got(rows):
    return sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in rows)


def test_statistics(spark, docs_of):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    extra = [(20, "a a a a", "x"), (21, "a b a b a", "x"), (22, "p q r\np q r\n\n\n \nz", "x"), (23, "a b c", "x")]
    for df in (spark.read.parquet(f"{FOLDER}/documents.parquet"), docs_of(ODD + extra)):
        rows = quality_rules(df, labels).collect()
        assert got(rows) == sorted((r.doc_id or -1, *brute(r.text)) for r in df.collect())
        assert not any(r.kept and r.base_failed for r in rows)


def test_verdict_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_rules"](spark, folder).collect() if r.doc_id in quality]
    good = [r for r in rows if quality[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in rows if quality[r.doc_id] == 0]
    assert np.mean([r.kept for r in good]) > 0.98 and np.mean([r.kept for r in bad]) < 0.1
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = keep_good(df, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} >= {r.doc_id for r in good}


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    rows = quality_rules(docs_of(ODD), none).collect()
    assert all(r.score is None and r.kept == (not r.base_failed) for r in rows)
    assert quality_rules(docs_of([]), none).count() == 0
    assert keep_good(docs_of([]), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 7, 1)], LABELS)
    assert quality_rules(docs_of(ODD), odd).count() == len(ODD)
    assert {r.score for r in score_quality(docs_of(ODD), fit_quality(docs_of(ODD), odd)).collect()} == {0.5}


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(6 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(scale=0.5, size=3000)) > 0).astype(float)
    forest = fit(x, y, {0: 1})
    for _ in range(20):
        row = np.repeat(rng.normal(size=(1, 3)), 200, axis=0)
        row[:, 0] = np.linspace(-3, 3, 200)
        assert (np.diff(forest.margin(row)) >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.8

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total
    assert np.allclose([walk(r) for r in x[:50]], forest.margin(x[:50]))


def test_classifier_held_out(spark, docs_of):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_classifier"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.8
    model = fit_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    odd = score_quality(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and score_quality(docs_of([]), model).count() == 0
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1


def plain_score(model, text):
    """The score word by word: its bucket, those of its n-grams, and one for each repeated word."""
    import xxhash
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    found = [subwords.SAME] * sum(a == b for a, b in zip(words, words[1:]))
    for w in words:
        found.append(xxhash.xxh32_intdigest(w) % subwords.BUCKETS)
        marked = f"<{w}>"
        for n in subwords.GRAMS:
            for at in range(len(marked) - n + 1):
                h = n
                for k in range(n):
                    h = (h + ord(marked[at + k])) * int(subwords._factors[k]) % 2 ** 64
                    h ^= h >> 17
                found.append(h % subwords.BUCKETS)
    mean = sum(float(model.weight[i]) for i in found) / len(found) if found else 0.0
    return 1 / (1 + math.exp(-(model.bias + mean)))


def test_scores_word_by_word(spark, docs_of):
    rng = np.random.default_rng(7)
    model = subwords.Model(rng.normal(size=subwords.BUCKETS + 1).astype(np.float32), 0.2)
    rows = ODD + [(20, "very very good é😀 a", "s"), (21, "x", "s")]
    got = {(r.doc_id, round(r.score, 9)) for r in score_quality(docs_of(rows), model).collect()}
    assert got == {(i, round(plain_score(model, t), 9)) for i, t, _ in rows}


def test_training_bags(spark, docs_of):
    rows = [(i, f"word{i} and and more" if i % 7 else None, "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0)], LABELS)
    made = {r["doc_id"]: r for r in subwords.training_bags(docs_of(rows), labels).to_pylist()}
    assert set(made) == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    for i, r in made.items():
        ids, shares = subwords.bags([rows[i][1] or ""])[0]
        assert r["buckets"] == ids.tolist() and np.allclose(r["shares"], shares) and r["quality"] == (1 if i == 1 else i % 2)
    assert len(subwords.training_bags(docs_of(rows), labels, sample=9)) == 9
    few = subwords.training_bags(docs_of(rows), labels, entries=300).to_pylist()
    assert 0 < len(few) < len(made) and sum(len(r["buckets"]) for r in few) <= 300


if __name__ == "__main__":
    pytest.main([__file__])
