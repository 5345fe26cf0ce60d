"""Supervised subword embeddings for text quality.

A document is the mean of the learned vectors of its words, of their character
n-grams and of word pairs that repeat a word, all hashed into one table; a softmax over two classes follows. Both are
trained together by stochastic gradient descent in numpy. As the output is linear
in the mean, a trained model keeps one number per bucket and class difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stylegraph.llm.common import groups, only, stable_hash
from stylegraph.sources.staging import settle

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 8, (2, 3, 4)
#: Labelled rows that training may read: those with the smallest hashes of their ids.
SAMPLE = 6_000
#: Buckets that the bags of training texts may have together: eight bytes each reach the driver.
ENTRIES = 16_000_000
#: Words a worker remembers, characters scored at a time.
REMEMBERED, GROUP = 500_000, 2_000_000
#: Bucket of the word pairs whose two words are the same, whatever the word.
SAME = BUCKETS
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_factors = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, ends marked: ``(number of the word, bucket)``."""
    import xxhash
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    whole = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64)
    owners, found = [np.arange(len(words))], [whole & (BUCKETS - 1)]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
        mixed = np.full(len(at), n, np.uint64)
        for k in range(n):
            mixed = (mixed + codes[at + k]) * _factors[k]
            mixed ^= mixed >> np.uint64(17)
        owners.append(owner[at])
        found.append((mixed & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Model:
    """Per bucket the difference of the two logits, and its bias."""

    weight: np.ndarray
    bias: float


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    number: dict[str, int] = {}
    split = [[number.setdefault(w, len(number)) for w in _words(t)] for t in texts]
    if not number:
        return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    owner, found = buckets(list(number))
    order = np.argsort(owner, kind="stable")
    found, sizes = found[order], np.bincount(owner)
    starts = np.cumsum(sizes) - sizes
    out = []
    for words in split:
        words = np.array(words, np.int64)
        own, times = np.unique(words, return_counts=True)
        n = sizes[own]
        at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ids, back = np.unique(found[at], return_inverse=True)
        share = np.bincount(back, weights=np.repeat(times, n), minlength=len(ids))
        if len(words):
            ids, share = np.append(ids, SAME), np.append(share, (words[1:] == words[:-1]).sum())
        out.append((ids, share / max(share.sum(), 1)))
    return out


def train(made: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 5, rate: float = 0.3, spread: float = 50.0,
          seed: int = 0) -> Model:
    """Learn vectors and softmax from ``bags`` by stochastic gradient descent with a falling rate.

    A document spreads its gradient over a thousand vectors, so these take ``spread`` times larger steps.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS + 1, DIMENSIONS)) / DIMENSIONS
    top, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    step, steps = 0, epochs * len(made)
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            now, step = rate * (1 - step / steps), step + 1
            ids, share = made[i]
            if not len(ids):
                continue
            vectors = table[ids]
            mean = share @ vectors
            logits = mean @ top + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = top @ p
            top -= now * np.outer(mean, p)
            bias -= now * p
            table[ids] = vectors - (now * spread) * share[:, None] * back      # ids are distinct
    lean = top[:, 1] - top[:, 0]
    return Model((table @ lean).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Adds up what each word contributes; words are looked up once per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0, np.int64)

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.number) > REMEMBERED:
            self.forget()
        split = [_words(t) for t in texts]
        number = self.number
        fresh = list({w for words in split for w in words if w not in number})
        if fresh:
            owner, found = buckets(fresh)
            self.sums = np.concatenate([self.sums, np.bincount(
                owner, weights=self.model.weight[found], minlength=len(fresh))])
            self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(fresh))])
            number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
        out = []
        for words in split:
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            same = int((at[1:] == at[:-1]).sum())
            n = int(self.sizes[at].sum()) + same
            total = float(self.sums[at].sum()) + same * float(self.model.weight[SAME])
            margin = self.model.bias + (total / n if n else 0.0)
            out.append(float(1 / (1 + np.exp(-margin))))
        return out


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> pa.Table:
    """``(doc_id, quality, buckets, shares)`` of at most ``sample`` labelled texts whose crc32(id) mod 5 is not 0.

    Those with the smallest hashes of their ids are taken, as many as have ``entries`` buckets together.
    Whole texts stay on the executors, which make the bags; only bags travel to the driver.
    """
    marked = (only(labels, doc_id="bigint", quality="int")
              .filter("quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
              .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = marked.withColumn("h", stable_hash(F.col("doc_id"))).orderBy("h", "doc_id").limit(sample)
    texts = (only(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("text", "quality", "h")]))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("h", pa.int64()),
                        ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in groups(batch.column("text"), GROUP):
                made, part = bags(some), batch.slice(at, len(some))
                ends = pa.array(np.cumsum([0] + [len(ids) for ids, _ in made], dtype=np.int32))
                flat = [np.concatenate(column) for column in zip(*made)]
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ("doc_id", "quality", "h")],
                    pa.ListArray.from_arrays(ends, pa.array(flat[0], pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.float32)))], schema=schema)
                at += len(some)

    rows = settle(texts.mapInArrow(make, "doc_id bigint, quality int, h bigint, buckets array<int>, shares array<float>"), "bags")
    total, last = 0, None
    for r in sorted(rows.select("h", "doc_id", F.size("buckets").alias("n")).collect()):      # at most ``sample`` rows
        total += r.n
        if total > entries:
            break
        last = r
    if last is None:
        return schema.empty_table().drop_columns("h")
    fits = (F.col("h") < last.h) | (F.col("h") == last.h) & (F.col("doc_id") <= last.doc_id)
    return rows.filter(fits).drop("h").toArrow().sort_by("doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model of ``labels.quality``; without labels of both kinds it is neutral (score 0.5)."""
    rows = training_bags(docs, labels, sample, entries)
    y = rows.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    found, shares = (rows.column(c).combine_chunks() for c in ("buckets", "shares"))
    ids, share, ends = found.flatten().to_numpy(), shares.flatten().to_numpy(), np.cumsum([0, *found.value_lengths().to_pylist()])
    return train([(ids[a:b], share[a:b]) for a, b in zip(ends, ends[1:])], y)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    Whole texts are scored. A null or empty text gets the score of the bias. A null
    id counts as the text '' for the fold. Repeated ids are scored row by row; no
    rows give no rows. The model (1 MB) travels with the tasks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [s for texts in groups(batch.column("text"), GROUP) for s in scorer.scores(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=schema)

    scored = only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double")
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return scored.select("doc_id", (F.crc32(text.cast("binary")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
