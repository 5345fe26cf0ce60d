"""Lookups that travel with the tasks, and answers made a few at a time."""

import pytest
from pyspark.sql import functions as F

from stylegraph.operators import curation as C, hooks as H, skew, tfidf


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_words_that_fit_travel_and_rows_stay(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MAX_HOT_BYTES", max(most, 1))
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    # no join is small enough for Spark's own threshold
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, None), (3, None)],
                                     "document_id bigint, feature string")
        kept = C.min_frequency_filter(rows, "feature", 2)
        assert sorted(map(tuple, kept.collect())) == [("a", 1), ("a", 1), ("a", 2)]
        if most:
            assert shuffles(kept) == 0
        cells = tfidf.doc_feature_matrix(rows, spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id bigint"))
        assert sorted(map(tuple, cells.fillna(-1).collect())) == [(1, 0, 1), (2, 0, 1), (2, 1, 1), (3, -1, 0), (4, -1, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_holds_few_answers(spark):
    def long(_, text):
        with open("/proc/self/status") as f:
            held = next(line.split()[1] for line in f if line.startswith("VmRSS"))
        return f"{held} " + "x" * 200_000

    requests = spark.range(0, 3000, 1, 1).select(F.lit("say").alias("instruction"), F.col("id").cast("string").alias("input"))
    made = H.generate_text(requests, long).select(F.split("generations", " ")[0].cast("bigint").alias("kb"))
    low, high, n = made.agg(F.min("kb"), F.max("kb"), F.count("kb")).first()
    assert n == 3000 and high - low < 250_000


def test_answers_of_nulls_and_empty_inputs(spark):
    requests = spark.createDataFrame([("say", "a"), ("say", ""), ("say", None)], "instruction string, input string")
    got = {r["input"]: r["generations"] for r in H.generate_text(requests, lambda i, t: t and t + "!").collect()}
    assert got == {"a": "a!", "": "", None: None}


def test_topics_of_documents_without_text(spark, tmp_path):
    from stylegraph.registry.all import QUERIES
    rows = [(1, "ab"), (2, None), (3, ""), (4, "ab"), (4, "ab"), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["document_topics"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2), (2, None), (3, 0), (4, 2), (4, 2), (5, None)]
