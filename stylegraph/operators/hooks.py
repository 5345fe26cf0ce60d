"""Where encoders, text generators and scorers supplied by the user plug in.

The defaults are stand-ins that need no model: hashed character n-grams for
encoding and token overlap for affinity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stylegraph.functions import text as X
from stylegraph.functions.vectors import difference, vector_mean
from stylegraph.operators.curation import map_with_fallback
from stylegraph.operators.skew import lookup_join

Encoder = Callable[[list[str]], "list[list[float]]"]
Generator = Callable[[str, str], str]

#: Requests that a task answers at a time; their texts may be long.
ANSWERED = 128


def encode_documents(df: DataFrame, text: str, make_encoder: Callable[[], Encoder] | None = None,
                     size: int = 256, n: int = 3, into: str = "embedding") -> DataFrame:
    """Add a vector per text.

    ``make_encoder`` is called once per Python worker and returns a function from
    a list of texts to a list of vectors.
    """
    if make_encoder is None:
        grams = NGram(n=n, inputCol="_chars", outputCol="_grams")
        hashed = HashingTF(numFeatures=size, inputCol="_grams", outputCol="_tf")
        unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit")
        rows = df.withColumn("_chars", F.split(F.lower(F.col(text)), ""))
        rows = unit.transform(hashed.transform(grams.transform(rows)))
        return rows.withColumn(into, vector_to_array("_unit")).drop(
            "_chars", "_grams", "_tf", "_unit")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make_encoder()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in run(batch.tolist())])

    return df.withColumn(into, encode(F.col(text)))


def generate_text(requests: DataFrame, generate: Generator, done: DataFrame | None = None,
                  into: str = "generations") -> DataFrame:
    """Answers ``(instruction, input, generations)`` for the distinct requests.

    ``requests(instruction, input)``; an empty input has an empty answer without
    a call. Requests already in ``done`` are taken from there.
    """
    keys = ["instruction", "input"]
    wanted = requests.select(*keys).distinct()
    fresh = wanted if done is None else wanted.join(done.select(*keys), keys, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANSWERED):
                part = batch.slice(at, ANSWERED).select(keys)
                answers = [generate(a, b) if b != "" else "" for a, b in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*keys, into])

    made = fresh.mapInArrow(run, f"instruction string, input string, {into} string")
    return made if done is None else made.unionByName(
        done.join(wanted, keys, "left_semi").select(*keys, into))


def zip_by_key(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Attach generated outputs to the rows they were made for."""
    return lookup_join(inputs, outputs, keys)


def ask(rows: DataFrame, instruction: str, prompt: Column, generate: Generator,
        done: DataFrame | None = None) -> DataFrame:
    """Add the answer to one prompt per row; equal prompts are asked once."""
    asked = rows.withColumn("instruction", F.lit(instruction)).withColumn("input", prompt)
    return zip_by_key(asked, generate_text(asked, generate, done), ["instruction", "input"])


def ask_if_any(rows: DataFrame, instruction: str, prompt: Column, generate: Generator) -> DataFrame:
    """:func:`ask` that keeps rows without a prompt: they have no answer, and nobody is asked."""
    asked = rows.withColumn("instruction", F.lit(instruction)).withColumn("input", prompt)
    answers = generate_text(asked.filter("input IS NOT NULL"), generate)
    return lookup_join(asked, answers, ["instruction", "input"], "left")


def styled_documents(styles: dict[str, str], generate: Generator, count: int,
                     topics: DataFrame) -> DataFrame:
    """Texts written in each style on each topic of ``topics(topic)``."""
    grid = X.style_grid(topics, styles)
    prompt = X.render_prompt("style_topic", F.upper("style_prompt"), F.col("topic"))
    return ask(grid, X.INSTRUCTIONS["style_topic"].replace("{}", str(count)), prompt, generate)


def rewrite_documents(docs: DataFrame, styles: dict[str, str], mode: str,
                      generate: Generator) -> DataFrame:
    """Documents ``(text)`` rewritten per style: amplify, reduce or rephrase."""
    if mode not in ("amplify", "reduce", "rephrase"):
        raise ValueError(f"unknown mode {mode}")
    grid = X.style_grid(docs, styles)
    prompt = F.col("text") if mode == "rephrase" else X.render_prompt(
        "rewrite", F.upper("style_prompt"), F.col("text"))
    return ask(grid, X.INSTRUCTIONS[mode], prompt, generate)


def document_topics(docs: DataFrame, generate: Generator) -> DataFrame:
    """The topic of each document ``(text)``: empty for an empty text, null without a text."""
    return ask_if_any(docs, X.INSTRUCTIONS["topic"], F.col("text"), generate).withColumnRenamed(
        "generations", "topic").drop("instruction", "input")


def describe_styles(docs: DataFrame, generate: Generator) -> DataFrame:
    """Level map and flat sentence list per document ``(text)``."""
    asked = ask(docs, X.INSTRUCTIONS["describe"], F.col("text"), generate)
    levels = X.extract_levels(F.col("generations"))
    return (asked.withColumn("style_description", levels)
            .withColumn("attribute_name", X.flatten_levels(F.col("style_description")))
            .drop("instruction", "input"))


def describe_cluster_styles(groups: DataFrame, generate: Generator,
                            styles: list[str] | None = None) -> DataFrame:
    """Common styles of groups of texts ``(id, texts array<string>)``."""
    instruction = X.INSTRUCTIONS["common"]
    if styles:
        listed = "\n".join(" - " + s.replace(".", "") for s in styles)
        instruction = X.INSTRUCTIONS["select"].replace("{}", listed)
    asked = ask(groups, instruction, X.numbered_concat(F.col("texts")), generate)
    return asked.withColumn("style_list", X.extract_markdown_attributes(F.col("generations")))


def shorten(features: DataFrame, generate: Generator) -> DataFrame:
    """``(feature, generations)`` of distinct features."""
    asked = ask(features.select("feature").distinct(), X.INSTRUCTIONS["shorten"],
                X.render_prompt("shorten", F.col("feature")), generate)
    return asked.select(X.strip_prefix(F.col("input")).alias("feature"), "generations")


def shorten_map(rows: DataFrame, feature: str, into: str, generate: Generator,
                lexicon: DataFrame, tags: DataFrame) -> DataFrame:
    """Shorten features, keeping only answers that are complete sentences."""
    made = shorten(rows.select(F.col(feature).alias("feature")), generate)
    judged = X.is_sentence_finished(made.select("generations").distinct(), "generations",
                                    lexicon, tags)
    good = judged.filter("finished").select("generations")
    accepted = made.join(good, "generations", "left_semi")
    return map_with_fallback(rows, accepted, feature, "feature", "generations", into)


def summarize(lists: DataFrame, generate: Generator, kind: str = "to_concise_paragraph") -> DataFrame:
    """One paragraph per list of sentences ``(cluster_label, features)``."""
    prompt = F.array_join("features", "\n")
    return ask(lists, X.INSTRUCTIONS[kind], prompt, generate).withColumnRenamed(
        "generations", "summary").drop("instruction", "input")


def rate_features(items: DataFrame, generate: Generator) -> DataFrame:
    """How strongly each feature applies to a text ``(text, features)``."""
    listed = F.array_join(F.transform("features", lambda f, i: F.concat(
        F.lit("feature-"), (i + 1).cast("string"), F.lit(": "), f)), "\n")
    body = F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n"))
    asked = ask(items, X.INSTRUCTIONS["rate"], X.render_prompt("features", body, listed), generate)
    return asked.withColumn("scores", X.parse_feature_scores(F.col("generations"), F.col("features")))


def style_direction_mean(rows: DataFrame) -> DataFrame:
    """Mean vector of the texts of each style: ``rows(style, embedding)``."""
    return rows.groupBy("style").agg(vector_mean(F.col("embedding")).alias("vector"))


def style_direction_delta(rows: DataFrame) -> DataFrame:
    """Mean change of vector by rewriting: ``rows(style, original, rewritten)``."""
    change = difference(F.col("rewritten"), F.col("original"))
    return rows.groupBy("style").agg(vector_mean(change).alias("vector"))
