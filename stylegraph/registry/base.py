"""Registration of queries and the derived views they share.

Each view is defined once for Spark and once as a DuckDB CTE over the same
parquet tables; both run over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stylegraph.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def documents(self) -> DataFrame:
        """Texts take long to process, so they are spread over the cores."""
        return spread(read_table(self.spark, self.folder, "documents"))

    @property
    def docs(self) -> DataFrame:
        """Every document with a vector, given or made from its text; the source plays the author."""
        e = self.embeddings.select(F.col("vec_id").alias("document_id"), F.col("label").alias("_label"),
                                   F.col("embedding").cast("array<double>").alias("_given"))
        d = self.documents.select(F.col("doc_id").alias("document_id"),
                                  F.col("source").alias("author_id"), "text")
        return d.join(e, "document_id", "left").select(
            "document_id", "author_id", "text",
            F.coalesce("_label", (F.col("document_id") % 10).cast("int")).alias("label"),
            F.coalesce("_given", text_vector(F.col("text"))).alias("embedding"))

    @property
    def docs50(self) -> DataFrame:
        """Vectors of 50 authors; ``side`` 0 is a query, 1 a candidate."""
        return self.embeddings.select(
            F.col("vec_id").alias("document_id"), (F.col("vec_id") % 50).alias("author_id"),
            (F.floor(F.col("vec_id") / 50) % 2).cast("bigint").alias("side"), "label",
            F.col("embedding").cast("array<double>").alias("embedding"))

    @property
    def quads(self) -> DataFrame:
        """Vectors with an author for each four of them, so that authors grow with the table."""
        return self.embeddings.select(
            F.col("vec_id").alias("document_id"), F.floor(F.col("vec_id") / 4).alias("author_id"),
            F.col("embedding").cast("array<double>").alias("embedding"))

    @property
    def assignments(self) -> DataFrame:
        """Every word of a document as a style feature, with its position."""
        listed = F.split(F.trim(F.lower("text")), r"\s+")
        return (self.documents.select(F.col("doc_id").alias("document_id"),
                                      F.posexplode(listed).alias("pos", "feature"))
                .filter("feature <> ''").withColumn("pos", F.col("pos").cast("bigint")))

    @property
    def features(self) -> DataFrame:
        """Every conversation turn, whole, as a style sentence."""
        from stylegraph.functions.text import strip
        return self.conversations.select(
            F.col("conv_id").alias("document_id"), "turn", strip(F.col("text")).alias("feature"))


def text_vector(text):
    """A stand-in for an encoder that SQL can compute too: 64 numbers from hashes of the text.

    Equal texts get equal vectors; different ones are as far apart as the given random vectors.
    """
    text = F.coalesce(text, F.lit(""))
    digits = F.concat(*[F.md5(F.concat(text, F.lit(str(k)))) for k in range(4)])
    # the hashes are bound once per row, not computed again for every number
    return F.get(F.transform(F.array(digits), lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(
        F.substr(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double") - 127.5)), F.lit(0))


CTE = {
    "docs": """docs AS (SELECT document_id, author_id, text, coalesce(label, (document_id % 10)::INT) AS label,
        coalesce(given, list_transform(generate_series(0, 63),
            lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::INT::DOUBLE - 127.5)) AS embedding
        FROM (SELECT d.doc_id AS document_id, d.source AS author_id, d.text, e.label, e.embedding::DOUBLE[] AS given,
            md5(coalesce(d.text, '') || '0') || md5(coalesce(d.text, '') || '1') || md5(coalesce(d.text, '') || '2')
            || md5(coalesce(d.text, '') || '3') AS digits
            FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id))""",
    "docs50": """docs50 AS (SELECT vec_id AS document_id, vec_id % 50 AS author_id,
        (vec_id // 50) % 2 AS side, label, embedding::DOUBLE[] AS embedding FROM embeddings)""",
    "quads": """quads AS (SELECT vec_id AS document_id, vec_id // 4 AS author_id,
        embedding::DOUBLE[] AS embedding FROM embeddings)""",
    "assignments": r"""assignments AS (SELECT document_id, pos, feature FROM (
        SELECT doc_id AS document_id, unnest(w) AS feature,
               unnest(generate_series(0, len(w) - 1)) AS pos
        FROM (SELECT doc_id, string_split_regex(trim(lower(text)), '\s+') AS w FROM documents))
        WHERE feature <> '')""",
    "features": r"""features AS (SELECT conv_id AS document_id, turn,
        regexp_replace(text, '^\s+|\s+$', '', 'g') AS feature FROM conversations)""",
}


def with_(*names: str, extra: str = "", recursive: bool = False) -> str:
    """A WITH clause holding the named views and further definitions."""
    parts = [CTE[n] for n in names] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its DuckDB text."""
    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return keep


def r6(expr, name: str):
    """A double rounded to 6 places, without negative zero."""
    column = F.col(expr) if isinstance(expr, str) else expr
    return (F.round(column.cast("double"), 6) + F.lit(0.0)).alias(name)
