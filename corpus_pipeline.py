"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage to the shared folder
and reads it back before the next one, so a lost executor never repeats a finished
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stylegraph.llm.mixing import emit, mix
from stylegraph.llm.near_dups import one_of_each
from stylegraph.llm.packing import pack_documents
from stylegraph.llm.personal_data import redact
from stylegraph.llm.quality_rules import keep_good
from stylegraph.llm.queries import tokenizer
from stylegraph.sources.staging import settle
from stylegraph.sources.tables import read_table, spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return one_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return emit(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets.

    The executors still hold the memory of the stages before, so workers remember fewer parts of texts.
    """
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), 1024, 2, remembered=100_000)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Trees, hashed signatures and the fitted patterns are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
