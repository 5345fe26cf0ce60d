"""Queries over readers, writers, labels and staging.

Files are written below the shared scratch folder from the tables and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from stylegraph.operators import attribution
from stylegraph.registry.base import Tables, query, r6, with_
from stylegraph.registry.space import COUNTS, IDF, WEIGHTS, space, space_sql
from stylegraph.sources import documents as S
from stylegraph.sources.staging import scratch_root, stage
from stylegraph.functions.text import DOCUMENT_SEPARATOR


def fresh(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark)}/stylegraph/{name}-{uuid.uuid4().hex}"


def as_documents(t: Tables):
    """Documents in the JSON form of the readers."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("documentID"), F.array("source").alias("authorIDs"),
        F.col("text").alias("fullText"), F.array("lang").alias("languages"),
        F.col("n_chars").cast("int").alias("lengthWords"))


@query("read_documents", """SELECT doc_id::VARCHAR AS document_id, source AS author, md5(text) AS hash,
    lang AS language, n_chars::INTEGER AS length_words FROM documents""")
def _read_documents(t: Tables):
    path = fresh(t, "documents")
    as_documents(t).write.json(path)
    return S.read_documents(t.spark, path).select(
        "document_id", F.col("author_ids")[0].alias("author"), F.md5("full_text").alias("hash"),
        F.col("languages")[0].alias("language"), "length_words")


@query("read_column_json", """SELECT doc_id AS idx, source AS "authorID", md5(text) AS hash FROM documents""")
def _read_column_json(t: Tables):
    """One column-oriented file per source."""
    path = fresh(t, "columns")

    def column(value):
        return F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), value)))

    t.documents.groupBy("source").agg(
        column(F.col("source")).alias("authorID"), column(F.col("text")).alias("fullText")).drop(
        "source").write.option("maxRecordsPerFile", 1).json(path)
    rows = S.read_column_json(t.spark, path, ["authorID", "fullText"])
    return rows.select("idx", "authorID", F.md5("fullText").alias("hash"))


@query("read_records_json", """SELECT doc_id::VARCHAR AS "documentID", source AS author FROM documents""")
def _read_records(t: Tables):
    """One JSON array of records per source."""
    path = fresh(t, "records")
    packed = as_documents(t).groupBy(F.col("authorIDs")[0].alias("_s")).agg(
        F.to_json(F.collect_list(F.struct("documentID", "authorIDs"))).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    schema = T.StructType([T.StructField("documentID", T.StringType()),
                           T.StructField("authorIDs", T.ArrayType(T.StringType()))])
    return S.read_records_json(t.spark, path, schema).select(
        "documentID", F.col("authorIDs")[0].alias("author"))


@query("first_author", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS author_id
    FROM documents""")
def _first_author(t: Tables):
    known = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    rows = t.documents.select("doc_id", known.alias("author_id"),
                              F.array("source", "lang").alias("author_ids"))
    return S.first_author(rows).select("doc_id", "author_id")


@query("decode_label", """SELECT doc_id, source AS author, lang AS other FROM documents""")
def _decode_label(t: Tables):
    wrapped = F.concat(F.lit("('"), "source", F.lit("',)"))
    either = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("('"), "lang", F.lit("',)"))).otherwise(
        F.col("lang"))
    return t.documents.select("doc_id", S.decode_label(wrapped, False).alias("author"),
                              S.decode_label(either).alias("other"))


@query("parse_list", """SELECT doc_id, pos, part FROM (SELECT doc_id, 0 AS pos, source AS part FROM documents
    UNION ALL SELECT doc_id, 1, lang FROM documents)""")
def _parse_list(t: Tables):
    literal = F.concat(F.lit("['"), "source", F.lit("', '"), "lang", F.lit("']"))
    bare = F.concat(F.lit("["), "source", F.lit(", "), "lang", F.lit("]"))
    text = F.when(F.col("doc_id") % 2 == 0, literal).otherwise(bare)
    return t.documents.select("doc_id", F.posexplode(S.parse_list(text)).alias("pos", "part"))


def sides(t: Tables):
    """Documents with an even number as queries, the others as candidates."""
    rows = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("author_id"),
                              F.col("text").alias("full_text"))
    return rows.filter("document_id % 2 = 0"), rows.filter("document_id % 2 = 1")


@query("merge_query_candidates", """SELECT doc_id AS document_id, source AS author_id, md5(text) AS hash,
    CASE WHEN doc_id % 2 = 0 THEN 'queries' ELSE 'candidates' END AS source FROM documents""")
def _merge(t: Tables):
    return S.merge_query_candidates(*sides(t)).select(
        "document_id", "author_id", F.md5("full_text").alias("hash"), "source")


def label_matches(t: Tables):
    """Two authors of the 50 match when they differ by 20 or 40."""
    authors = t.docs50.select("author_id").distinct()
    other = authors.select(F.col("author_id").alias("candidate_author"),
                           (F.col("author_id") % 20).alias("k"))
    return authors.filter("author_id >= 20").select(
        F.col("author_id").alias("query_author"), (F.col("author_id") % 20).alias("k"),
        F.col("author_id").alias("query_idx")).join(other.filter("candidate_author < 20"), "k").drop("k")


@query("resolve_candidates", """WITH authors AS (SELECT DISTINCT vec_id % 50 AS a FROM embeddings)
    SELECT e.vec_id AS document_id, coalesce(m.q, e.vec_id % 50) AS author_id FROM embeddings e
    LEFT JOIN (SELECT a % 20 AS c, min(a) AS q FROM authors WHERE a >= 20 GROUP BY 1) m
    ON m.c = e.vec_id % 50""")
def _resolve(t: Tables):
    rows = t.docs50.select("document_id", F.col("author_id").alias("candidate_author"))
    return S.resolve_candidates(rows, label_matches(t)).select("document_id", "author_id")


@query("matrix_to_pairs", """WITH authors AS (SELECT DISTINCT vec_id % 50 AS a FROM embeddings)
    SELECT q.a AS query_idx, 'q' || q.a AS query_author, 'c' || c.a AS candidate_author
    FROM authors q JOIN authors c ON q.a % 7 = c.a % 7""")
def _matrix(t: Tables):
    authors = t.docs50.select("author_id").distinct()
    cells = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.when(
        i % 7 == F.col("author_id") % 7, 1).otherwise(0))
    rows = authors.select(F.col("author_id").alias("row_idx"), cells.alias("cells"))
    label = F.col("author_id").cast("string")
    q = authors.select(F.col("author_id").alias("idx"), F.concat(F.lit("q"), label).alias("label"))
    c = authors.select(F.col("author_id").alias("idx"), F.concat(F.lit("c"), label).alias("label"))
    return S.matrix_to_pairs(rows, q, c)


@query("style_csv_io", "SELECT conv_id, turn, role, md5(text) AS hash FROM conversations")
def _csv(t: Tables):
    path = fresh(t, "styles")
    S.write_style_csv(t.conversations, path)
    back = S.read_style_csv(t.spark, path, t.conversations.schema)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("hash"))


@query("write_space", """SELECT 'authors' AS part, count(DISTINCT source) AS n FROM documents
    UNION ALL SELECT 'documents', count(*) FROM documents""")
def _write_space(t: Tables):
    from stylegraph.plans.space import build_space
    path = fresh(t, "space")
    made = build_space(t.docs, t.assignments.select("document_id", "feature"), 0.80)
    S.write_space(path, **made)
    rows = None
    for part in ("authors", "documents"):
        here = S.read_space(t.spark, path, part).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(part).alias("part"), "n")
        rows = here if rows is None else rows.unionByName(here)
    return rows


@query("read_space", space_sql(IDF, COUNTS, WEIGHTS) + """
    SELECT cluster_label, feature, round(weight, 6) + 0.0 AS weight FROM weights""")
def _read_space(t: Tables):
    path = fresh(t, "space")
    S.write_space(path, weights=space(t)[3])
    return S.read_space(t.spark, path, "weights").select("cluster_label", "feature", r6("weight", "weight"))


@query("write_explanations", """SELECT doc_id AS document_id, string_split(source, 'c')[1] AS feature
    FROM documents""")
def _write_explanations(t: Tables):
    path = fresh(t, "explanations")
    rows = t.documents.select(F.col("doc_id").alias("document_id"), F.split("source", "c").alias("features"))
    S.write_explanations(rows, path)
    back = t.spark.read.schema(rows.schema).json(path)
    return back.select("document_id", F.col("features")[0].alias("feature"))


@query("stage", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _stage(t: Tables):
    path = fresh(t, "stage")
    build = lambda: t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    stage(t.spark, path, build)

    def never():
        raise AssertionError("a finished stage is not run again")

    return stage(t.spark, path, never)


@query("resume_pending", """SELECT conv_id, turn FROM conversations
    WHERE conv_id NOT IN (SELECT doc_id FROM labels)""")
def _resume(t: Tables):
    done = t.labels.select(F.col("doc_id").alias("conv_id"))
    return S.resume_pending(t.conversations.select("conv_id", "turn"), done, ["conv_id"])


@query("discover_role_files", """SELECT doc_id::VARCHAR AS document_id, source AS author_id,
    'set1' AS prefix FROM documents WHERE doc_id % 2 = 0""")
def _roles(t: Tables):
    root = fresh(t, "roles")
    queries = as_documents(t).filter("cast(documentID as bigint) % 2 = 0").select(
        "documentID", "authorIDs", "fullText")
    candidates = as_documents(t).filter("cast(documentID as bigint) % 2 = 1").select(
        "documentID", F.col("authorIDs").alias("authorSetIDs"), "fullText")
    # folders named like the files of the two roles, one file name for all tasks
    queries.write.json(f"{root}/set1_TA2_queries")
    candidates.write.json(f"{root}/set1_TA2_candidates")
    return S.read_role_files(t.spark, root, "queries").select(
        "document_id", F.col("author_ids")[0].alias("author_id"), "prefix")


@query("flatten_struct", "SELECT doc_id AS id, source AS meta_source, lang AS meta_place_lang FROM documents")
def _flatten(t: Tables):
    nested = t.documents.select(F.col("doc_id").alias("id"), F.struct(
        "source", F.struct("lang").alias("place")).alias("meta"))
    return S.flatten_struct(nested)


@query("group_by_author", """SELECT source AS author_id, (pos // 1024) AS part, count(*) AS n,
    md5(string_agg(doc_id::VARCHAR || ' ' || text, '|' ORDER BY pos)) AS hash FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
    GROUP BY 1, 2""")
def _group_by_author(t: Tables):
    docs = t.documents.select(F.col("source").alias("author_id"), F.col("doc_id").alias("document_id"), "text")
    parts = attribution.group_by_author(docs)
    lines = F.zip_with("document_id", "text", lambda i, x: F.concat(i.cast("string"), F.lit(" "), x))
    return parts.select("author_id", "part", F.size("text").cast("bigint").alias("n"),
                        F.md5(F.array_join(lines, "|")).alias("hash"))


@query("join_texts", f"""SELECT source AS author_id, (pos // 1024) AS part,
    md5(string_agg(text, '{DOCUMENT_SEPARATOR}' ORDER BY pos)) AS hash FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
    GROUP BY 1, 2""")
def _join_texts(t: Tables):
    docs = t.documents.select(F.col("source").alias("author_id"), F.col("doc_id").alias("document_id"), "text")
    joined = attribution.join_texts(attribution.group_by_author(docs), DOCUMENT_SEPARATOR)
    return joined.select("author_id", "part", F.md5("full_text").alias("hash"))


@query("concat_steps", """SELECT conv_id AS id, md5(text) AS hash FROM conversations
    UNION ALL SELECT item_id, md5(text) FROM benchmark""")
def _concat(t: Tables):
    a = t.conversations.select(F.col("conv_id").alias("id"), F.md5("text").alias("hash"))
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.md5("text").alias("hash")))


@query("drop_nulls", """SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def _drop_nulls(t: Tables):
    from stylegraph.operators.curation import drop_nulls
    return drop_nulls(t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left"))
