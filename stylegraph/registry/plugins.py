"""Queries over encoders and generators, run with deterministic stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stylegraph.functions import text as X
from stylegraph.functions import vectors as V
from stylegraph.operators import hooks as H
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.registry.space import _MEAN_ROWS, _long, space
from stylegraph.registry.text import STYLES, lexicon_words
from stylegraph.operators import tfidf
from stylegraph.plans.styles import generate_styles
from stylegraph.sources.staging import scratch_root


def shout(instruction: str, text: str) -> str:
    """A stand-in generator: length of the instruction, then the text reversed."""
    return f"{len(instruction)} {text[::-1]}"


def describe(instruction: str, text: str) -> str:
    """A stand-in level answer."""
    return (f"Here it is\n\n**Morphological Level:**\n\n- The author uses {len(text)} signs.\n\n"
            f"Discourse Level\n\n* The author is {'long' if len(text) > 500 else 'short'}.")


def short(instruction: str, text: str) -> str:
    """A stand-in shortener: keeps the first sentence of short inputs only."""
    body = text.replace("[SENTENCE]: ", "")
    return body.split(".")[0] + "." if len(body) < 400 else body.rstrip(".!? ")


@query("encode_documents")
def _encode(t: Tables):
    rows = H.encode_documents(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", r6(V.norm(F.col("embedding")), "norm"),
                       F.size("embedding").cast("bigint").alias("size"))


@query("generate_text", """SELECT conv_id, turn, md5('5 ' || reverse(text)) AS hash FROM conversations""")
def _generate(t: Tables):
    rows = H.ask(t.conversations, "shout", F.col("text"), shout)
    return rows.select("conv_id", "turn", F.md5("generations").alias("hash"))


@query("zip_by_key", """SELECT c.conv_id, c.turn, l.quality FROM conversations c
    JOIN labels l ON l.doc_id = c.conv_id""")
def _zip(t: Tables):
    out = t.labels.select(F.col("doc_id").alias("conv_id"), "quality")
    return H.zip_by_key(t.conversations, out, ["conv_id"]).select("conv_id", "turn", "quality")


@query("describe_styles", """SELECT doc_id, 'The author uses ' || length(text) || ' signs.' AS first,
    CASE WHEN length(text) > 500 THEN 'The author is long.' ELSE 'The author is short.' END AS last,
    'other' AS middle FROM documents""")
def _describe(t: Tables):
    rows = H.describe_styles(t.documents.select("doc_id", "text"), describe)
    levels = F.col("style_description")
    return rows.select("doc_id", levels["Morphological Level"][0].alias("first"),
                       levels["Discourse Level"][0].alias("last"),
                       levels["Semantic Level"][0].alias("middle"))


@query("styled_documents", """SELECT conv_id, style, md5('[ATTRIBUTES]: Writing Style Attribute: ' ||
    upper(style_prompt) || ', Topic Attribute: ' || text) AS hash FROM conversations,
    (VALUES ('plain', 'The author is plain.'), ('formal', 'The author is formal.')) AS s(style, style_prompt)""")
def _styled(t: Tables):
    topics = t.conversations.select("conv_id", F.col("text").alias("topic"))
    rows = H.styled_documents(STYLES, lambda i, x: x, 3, topics)
    return rows.select("conv_id", "style", F.md5("generations").alias("hash"))


@query("rewrite_documents", """SELECT doc_id, style, md5(text) AS hash FROM documents,
    (VALUES ('plain'), ('formal')) AS s(style)""")
def _rewrite(t: Tables):
    rows = H.rewrite_documents(t.documents.select("doc_id", "text"), STYLES, "rephrase", lambda i, x: x)
    return rows.select("doc_id", "style", F.md5("generations").alias("hash"))


@query("shorten_map")
def _shorten_map(t: Tables):
    lexicon = lexicon_words(t)
    tags = lexicon.select(F.col("word").alias("token"), F.lit("NOUN").alias("tag"))
    once = H.shorten_map(t.features, "feature", "shortened_v1", short, lexicon, tags)
    return H.shorten_map(once, "shortened_v1", "shortened_v2", short, lexicon, tags)


@query("summarize", f"""SELECT conv_id, count(*) AS features,
    md5('{len(X.INSTRUCTIONS["to_concise_paragraph"])} ' || reverse(string_agg(text, chr(10)
    ORDER BY turn))) AS hash FROM conversations GROUP BY conv_id""")
def _summarize(t: Tables):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "text"))).alias("l")).select("conv_id", F.col("l.text").alias("features"))
    rows = H.summarize(lists, shout)
    return rows.select("conv_id", F.size("features").cast("bigint").alias("features"),
                       F.md5("summary").alias("hash"))


@query("rate_features", """SELECT doc_id, 'formal' AS feature, '3' AS score FROM documents
    UNION ALL SELECT doc_id, source, '1' FROM documents""")
def _rate(t: Tables):
    rows = t.documents.select("doc_id", "text", F.array(F.lit("formal"), F.col("source")).alias("features"))
    rated = H.rate_features(rows, lambda i, x: "feature-1: formal - Score: 3\nfeature-2: it is - Score: 1")
    return rated.select("doc_id", F.explode("scores").alias("e")).select("doc_id", "e.feature", "e.score")


@query("document_topics", """SELECT doc_id, length(text) AS size FROM documents""")
def _topics(t: Tables):
    rows = H.document_topics(t.documents.select("doc_id", "text"), lambda i, x: str(len(x)))
    # an empty text is answered by an empty topic
    return rows.select("doc_id", F.when(F.col("topic") == "", 0).otherwise(F.col("topic").cast("bigint")).alias("size"))


@query("describe_cluster_styles", """SELECT conv_id, 'many turns' AS style FROM conversations
    GROUP BY conv_id""")
def _cluster_styles(t: Tables):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "text"))).alias("l")).select("conv_id", F.col("l.text").alias("texts"))
    rows = H.describe_cluster_styles(lists, lambda i, x: "They show **many turns (often)** here")
    return rows.select("conv_id", F.explode("style_list").alias("style"))


@query("style_direction_mean", """WITH s AS (SELECT label AS author_id, embedding::DOUBLE[] AS embedding FROM embeddings),
    means AS (SELECT author_id, list(v ORDER BY pos) AS vector FROM (SELECT author_id, pos, avg(x) AS v FROM (
        SELECT author_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM s)
        GROUP BY 1, 2) GROUP BY 1)""" + _MEAN_ROWS.format(key="author_id", vector="vector", table="means").replace(
        "SELECT author_id, pos", "SELECT author_id::BIGINT AS style, pos", 1))
def _direction_mean(t: Tables):
    rows = t.docs50.select(F.col("label").cast("bigint").alias("style"), "embedding")
    return _long(H.style_direction_mean(rows), "style", "vector")


@query("style_direction_delta", """WITH pairs AS (SELECT a.label::BIGINT AS style, a.embedding::DOUBLE[] AS a,
        b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    long AS (SELECT style, unnest(a) AS x, unnest(b) AS y, unnest(generate_series(0, len(a) - 1)) AS pos FROM pairs)
    SELECT style, pos, round(avg(y - x), 6) + 0.0 AS x FROM long GROUP BY style, pos""")
def _direction_delta(t: Tables):
    docs = t.docs50
    after = docs.select((F.col("document_id") - 1).alias("document_id"), F.col("embedding").alias("rewritten"))
    rows = docs.join(after, "document_id").select(
        F.col("label").cast("bigint").alias("style"), F.col("embedding").alias("original"), "rewritten")
    return _long(H.style_direction_delta(rows), "style", "vector")


@query("generate_styles")
def _generate_styles(t: Tables):
    """All stages from documents to mined phrases."""
    name = F.split("p_name", " ")
    tags = (t.part.select(name[0].alias("token"), F.lit("ADJ").alias("tag"))
            .union(t.part.select(name[1], F.lit("NOUN"))).distinct())
    lexicon = tags.select(F.col("token").alias("word"))
    wording = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy("p_name")
    styles = [r["p_name"] for r in wording.collect()]

    def describe_by_length(instruction: str, text: str) -> str:
        style = styles[len(text) % len(styles)]
        return f"Here:\n\nSyntactic Level:\n\n- The author likes {style}.\n- The author uses {style} often."

    path = f"{scratch_root(t.spark)}/stylegraph/styles-{uuid.uuid4().hex}"
    docs = t.documents.select(F.col("doc_id").alias("document_id"), "text")
    return generate_styles(docs, path, describe_by_length, lambda i, x: x.replace("[SENTENCE]: ", ""),
                           lexicon, tags, 2, eps=1.0)
