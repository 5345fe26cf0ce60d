"""From documents to a curated table of style features, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylegraph.functions import text as X
from stylegraph.operators import curation as C
from stylegraph.operators import hooks as H
from stylegraph.operators.skew import lookup_join
from stylegraph.operators.tfidf import feature_level
from stylegraph.sources.staging import stage


def generate_styles(docs: DataFrame, path: str, describe: H.Generator, shorten: H.Generator,
                    lexicon: DataFrame, tags: DataFrame, threshold: int = 2,
                    compose: bool = True, **refine) -> DataFrame:
    """Style features per document, every stage written below ``path`` and reused.

    ``docs(document_id, text)``; ``lexicon(word)`` and ``tags(token, tag)`` judge
    sentences and mine phrases. Returns ``(final_attribute_name,
    original_attribute_name, document_id, shortened_v1, shortened_v2,
    aggregated_name)``, one row per mined phrase.
    """
    spark = docs.sparkSession
    described = stage(spark, f"{path}/described", lambda: H.describe_styles(docs, describe).select(
        "document_id", "style_description", "attribute_name"))
    stage(spark, f"{path}/levels", lambda: feature_level(
        described.withColumnRenamed("style_description", "level_map"), "document_id"))
    rows = described.select("document_id", F.posexplode("attribute_name").alias("pos", "attribute_name"))

    def shortened() -> DataFrame:
        once = H.shorten_map(rows, "attribute_name", "shortened_v1", shorten, lexicon, tags)
        return H.shorten_map(once, "shortened_v1", "shortened_v2", shorten, lexicon, tags)

    corpus = stage(spark, f"{path}/shortened", shortened)
    kept = stage(spark, f"{path}/filtered", lambda: C.drop_nulls(
        C.min_frequency_filter(corpus, "shortened_v2", threshold)))
    lines = kept.withColumn("shortened_v2", X.first_line(F.col("shortened_v2")))
    merged = stage(spark, f"{path}/aggregated", lambda: C.canonical_features(
        lines, "shortened_v2", ["document_id", "pos"], compose, **refine))

    def final() -> DataFrame:
        phrases = X.mine_phrases(merged, tags, "aggregated_name")
        found = lookup_join(merged, phrases.withColumnRenamed("feature", "aggregated_name"),
                            ["aggregated_name"])
        return found.select(
            F.explode("phrases").alias("final_attribute_name"),
            F.col("attribute_name").alias("original_attribute_name"), "document_id",
            "shortened_v1", "shortened_v2", "aggregated_name")

    return stage(spark, f"{path}/final", final)
