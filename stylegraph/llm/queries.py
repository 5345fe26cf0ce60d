"""The queries of this package over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stylegraph.llm import spelling, walsh_clusters
from stylegraph.llm.mixing import mix
from stylegraph.llm.near_dups import near_duplicates
from stylegraph.llm.packing import pack_documents
from stylegraph.llm.personal_data import find_personal_data, summary
from stylegraph.llm.piece_chunks import decode_pieces, encode_pieces
from stylegraph.llm.quality_rules import quality_rules
from stylegraph.llm.subwords import fit_quality, score_quality
from stylegraph.llm.token_counts import count_tokens
from stylegraph.llm.token_files import read_token_files, write_token_files
from stylegraph.llm.url_filters import judge_urls, oracle_sql
from stylegraph.llm.vector_dups import vector_duplicates
from stylegraph.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_mix_sources", r"""
WITH RECURSIVE d AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS bin,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    3 * sum(size)::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM d GROUP BY source),
level(k, v, n) AS (
    SELECT 0, 0.0::DOUBLE, -1::BIGINT
    UNION ALL
    SELECT k + 1, ((SELECT sum(source_size)::DOUBLE FROM s)
                   - (SELECT coalesce(sum(cap) FILTER (cap < weight * v), 0) FROM s))
                  / (SELECT sum(weight) FILTER (NOT cap < weight * v) FROM s),
           (SELECT count(*) FILTER (cap < weight * v) FROM s)
    FROM level WHERE n <> (SELECT count(*) FILTER (cap < weight * v) FROM s)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_max(v, k) FROM level)) AS target FROM s),
r AS (SELECT h.*, row_number() OVER (PARTITION BY source ORDER BY bin, hash, doc_id, size) - 1 AS place FROM h),
c AS (SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, place,
    (('0x' || substr(md5('0:' || coalesce(r.source, '')), 1, 15))::BIGINT >> 28) / 4294967296.0::DOUBLE AS u
    FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (least(floor(rate * (place + 1) + u) - floor(rate * place + u), 3) * size)::BIGINT AS taken FROM c""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_prefix_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), tokenizer("piece_bpe_32k.model"), 4096)


@query("op3_pattern_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), tokenizer("byte_bpe_50k.json"), 1024, 2)


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_token_files(documents(spark, folder), tokenizer("byte_bpe_50k.json"), 0)
    return read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder), read_table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_quality(docs, fit_quality(docs, read_table(spark, folder, "labels")))


@query("op9_circulant_minhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), words=2, percent=80)


@query("op5_multi_index_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return vector_duplicates(spread(read_table(spark, folder, "embeddings")), 0.93)


@query("op2_contextual_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return summary(find_personal_data(documents(spark, folder)))


@query("op10_link_graph_filter", oracle_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(read_table(spark, folder, "pages"))
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op11_trie_spelling", spelling.oracle_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


@query("op12_chunk_pieces")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    both = decode_pieces(encode_pieces(documents(spark, folder), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_walsh_clusters", walsh_clusters.oracle_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return walsh_clusters.cluster_vectors(spread(read_table(spark, folder, "embeddings")))
