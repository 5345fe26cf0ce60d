"""Readers and writers for documents, authors, ground truth and style tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stylegraph.operators.skew import lookup_join

DOCUMENT = T.StructType([
    T.StructField("documentID", T.StringType()),
    T.StructField("authorIDs", T.ArrayType(T.StringType())),
    T.StructField("fullText", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("lengthWords", T.IntegerType()),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines documents with snake_case names."""
    rows = spark.read.schema(DOCUMENT).json(path)
    return rows.select(
        F.col("documentID").alias("document_id"), F.col("authorIDs").alias("author_ids"),
        F.col("fullText").alias("full_text"), "languages",
        F.col("lengthWords").alias("length_words"))


def read_records_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files holding one JSON array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_column_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files in the column-oriented form ``{column: {index: value}}``, as rows.

    Such a file is one JSON value, so one task parses one file; large data come
    as many files. Rows keep their file, as every file counts its rows anew.
    Values are returned as JSON text or plain strings.
    """
    schema = T.StructType([
        T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in columns])
    files = (spark.read.schema(schema).option("multiLine", True).json(path)
             .select(F.input_file_name().alias("file"), *columns))
    cells = files.select("file", F.explode(F.map_keys(columns[0])).alias("idx"), *columns)
    return cells.select("file", F.col("idx").cast("bigint").alias("idx"),
                        *[F.element_at(F.col(c), F.col("idx")).alias(c) for c in columns])


def first_author(df: DataFrame, ids: str = "author_ids", name: str = "author_id") -> DataFrame:
    """The author column where present, else the first of the author list."""
    first = F.get(F.col(ids), F.lit(0))
    return df.withColumn(name, F.coalesce(F.col(name), first) if name in df.columns else first)


def decode_label(label: Column, only_if_wrapped: bool = True) -> Column:
    """``('x',)`` becomes ``x``."""
    inner = F.substring(label, F.lit(3), F.length(label) - 5)
    return F.when(label.startswith("("), inner).otherwise(label) if only_if_wrapped else inner


def parse_list(text: Column) -> Column:
    """List text such as ``['a', 'b']`` as an array.

    Text that is no list literal loses its brackets and quotes and is cut at
    ``", "``.
    """
    literal = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), "'", "")
    return F.coalesce(literal, F.split(bare, ", "))


def merge_query_candidates(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates and queries as one table tagged with ``source``."""
    columns = ["author_id", "full_text", "document_id"]
    return (candidates.select(*columns).withColumn("source", F.lit("candidates"))
            .unionByName(queries.select(*columns).withColumn("source", F.lit("queries"))))


def resolve_candidates(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Give each candidate author the first matching query author, else itself.

    ``matches(query_idx, query_author, candidate_author)``; first means smallest
    index. Adds ``author_id``.
    """
    first = matches.groupBy("candidate_author").agg(
        F.min_by("query_author", "query_idx").alias("_query"))
    return (lookup_join(candidates, first, ["candidate_author"], "left")
            .withColumn("author_id", F.coalesce("_query", "candidate_author")).drop("_query"))


def matrix_to_pairs(rows: DataFrame, query_labels: DataFrame,
                    candidate_labels: DataFrame) -> DataFrame:
    """Matches of a 0/1 matrix ``(row_idx, cells)`` with label tables ``(idx, label)``."""
    cells = rows.select("row_idx", F.posexplode("cells").alias("col_idx", "value"))
    hits = cells.filter("value = 1")
    q = query_labels.select(F.col("idx").alias("row_idx"), F.col("label").alias("query_author"))
    c = candidate_labels.select(F.col("idx").alias("col_idx"),
                                F.col("label").alias("candidate_author"))
    return hits.join(q, "row_idx").join(c, "col_idx").select(
        F.col("row_idx").alias("query_idx"), "query_author", "candidate_author")


CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def write_style_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def read_style_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.options(**CSV).schema(schema).csv(path)


SPACE_PARTS = ("documents", "authors", "centroids", "weights", "summaries")


def write_space(path: str, **parts: DataFrame) -> None:
    """Write clustered documents, authors, centroids, weights and summaries below ``path``."""
    for name in SPACE_PARTS:
        if name in parts:
            parts[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_space(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}")


def write_explanations(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Long score table ``(query_author, candidate_author, score)``."""
    scores.select("query_author", "candidate_author", "score").write.mode(
        "overwrite").parquet(path)


def resume_pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that have no response yet."""
    return inputs.join(done.select(*keys), keys, "left_anti")


def read_role_files(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """Documents from the ``*queries*`` or ``*candidates*`` files (or folders of files).

    ``prefix`` is the data set name before ``_TA2`` in the file name.
    """
    rows = spark.read.schema(T.StructType([
        T.StructField("documentID", T.StringType()),
        T.StructField("authorIDs", T.ArrayType(T.StringType())),
        T.StructField("authorSetIDs", T.ArrayType(T.StringType())),
        T.StructField("fullText", T.StringType())])).json(f"{folder}/*{role}*")
    return rows.select(
        F.col("documentID").alias("document_id"),
        F.coalesce("authorIDs", "authorSetIDs").alias("author_ids"),
        F.col("fullText").alias("full_text"),
        F.regexp_extract("_metadata.file_path", "([^/]*?)_TA2", 1).alias("prefix"))


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as flat columns joined with ``sep``; maps stay as they are."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))
