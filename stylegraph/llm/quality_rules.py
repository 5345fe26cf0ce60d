"""Quality rules: document statistics, fixed base rules and boosted trees over the statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stylegraph.llm.common import only, stable_hash
from stylegraph.llm.trees import Forest, fit
from stylegraph.sources.staging import settle

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct", "n_longest", "n_most")
_symbols = re.compile(r"[#*$%&|<>]")
_words = re.compile(r"[^\x20\x09-\x0D]+")
_upper, _lower = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")
_digits, _marks = re.compile("[0-9]"), re.compile(r"[.,;:!?]")

#: Labelled rows used to fit the trees: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: A document stays when the trees give label 1 at least this probability.
KEEP = 0.3


def describe(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = _words.findall(text)
    n = len(words)
    lines, again, seen = 0, 0, set()
    for line in text.split("\n"):
        if _words.search(line):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        k = len(number)
        pair = codes[:-1] * k + codes[1:]
        if k > 2_000_000:                      # keeps the triple below 2**63
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(triple := pair[:-1] * k + codes[2:], kind="stable")
        same = triple[order][1:] == triple[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[shift:n - 2 + shift] |= twice
        repeated = int(inside.sum())
    return (n, sum(map(len, words)), len(_symbols.findall(text)), again, repeated, lines,
            len(_upper.findall(text)), len(_lower.findall(text)), len(_digits.findall(text)),
            len(_marks.findall(text)), len(number), max(map(len, words), default=0),
            int(np.bincount(codes).max()) if n else 0)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text of ``docs(doc_id, text)``; null has none."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([describe(t.as_py() or "") for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(made[:, i]) for i in range(len(COUNTS))]], schema=schema)

    return only(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: Features of the trees, and those in which the score may only fall.
FEATURES = ("log_words", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "mark_share", "distinct_share", "word_length", "longest", "most_share", "symbols_per_char")
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "symbols_per_char")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars, c["n_marks"] / words,
        c["n_distinct"] / words, c["word_chars"] / words, np.log1p(c["n_longest"]), c["n_most"] / words,
        c["n_symbols"] / chars], axis=1).astype(float)


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Fit the trees to ``labels(doc_id, quality)``; None without both kinds of labels.

    Only the ``sample`` labelled rows whose ids have the smallest hashes are used,
    and of them only the counts reach the driver.
    """
    marked = only(labels, doc_id="bigint", quality="int").filter("quality in (0, 1) and doc_id is not null")
    chosen = marked.withColumn("_h", stable_hash(F.col("doc_id"))).orderBy("_h", "doc_id", "quality").limit(sample)
    rows = stats.join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").orderBy(
        "doc_id", *COUNTS, "quality").limit(4 * sample).toArrow()
    y = rows.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = features({c: rows.column(c).to_numpy().astype(float) for c in COUNTS})
    return fit(x, y, {FEATURES.index(f): -1 for f in FALLING})


def judge(stats: DataFrame, forest: Forest | None, keep: float = KEEP) -> DataFrame:
    """Adds ``base_failed``, ``score`` (probability of label 1) and ``kept``."""
    failed: Column = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    if forest is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.probability(features(
                {c: batch.column(c).to_numpy().astype(float) for c in COUNTS}))
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (score >= keep)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(kept)],
                                             names=[*names, "score", "kept"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{head}, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Statistics and verdict for each row of ``docs(doc_id, text)``.

    Returns ``doc_id``, the counts, ``base_failed``, ``score`` and ``kept``. A null or empty
    text has no words, so the base rules reject it. Null and repeated ids are
    judged like others. Without labels of both kinds there are no trees: the score is
    null and the base rules decide alone. No rows give no rows.
    """
    stats = settle(statistics(docs), "statistics")
    return judge(stats, train(stats, labels, sample), keep)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, unchanged and without a shuffle.

    The trees come from a first pass over the texts; a second one judges each row by its own text.
    """
    forest = train(settle(statistics(docs), "statistics"), labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([describe(t.as_py() or "") for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            c = {name: made[:, i].astype(float) for i, name in enumerate(COUNTS)}
            good = ~((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"]))
            if forest is not None and len(made):
                good &= forest.probability(features(c)) >= keep
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
