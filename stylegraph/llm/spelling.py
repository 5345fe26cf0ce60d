"""Spelling variants: words at one edit from each other, found on a trie held in tables.

The trie is a table of edges ``(side, node, char, child)``. A node is a prefix at which
words part, so its string is its key, and an edge may stand for several code points. It is
built level by level: each word stands at a node, and the words that leave a node
by the same code point go on to their common prefix, that of the first and the last of them.

States ``(word, position, node, edits)`` then travel down. With no edit a word stands on
its own path. One edit moves it to another child of its node, from where it follows equal
code points, one edge a round, until word and path end at a word: a neighbour.

Of the two halves of a word one edit leaves one as it is. So states leave a word's path only
below its first half, and a second trie of reversed words finds the edits of the
first half. Neither trie is searched near its root, where every node has all children.
"""

from __future__ import annotations

import os
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stylegraph.operators.skew import lookup_join
from stylegraph.llm.common import only
from stylegraph.sources.staging import settle

#: Code points of words; ``A-Z`` are lower-cased, the others stay.
LETTERS = "A-Za-zÀ-ÿ"
#: Edges into the tries start with so many code points; no word parts from another above.
FIRST = 3
KEYS = ["side", "node"]


def word_counts(docs: DataFrame, shortest: int = 7, fewest: int = 2) -> DataFrame:
    """``(word, n)`` of all words with ``shortest`` code points and ``fewest`` occurrences.

    Where 31 divides the crc32 ``h`` of ``<doc_id>:<word>``, the word loses its code point
    ``h % length``: a fixed share of spelling slips.
    """
    # runs that are too short stay too short
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    runs = only(docs, doc_id="string", text="string").select("doc_id", F.explode(found).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
                     ).otherwise(F.col("run"))
    named = runs.select("doc_id", lowered.alias("run")).select("run", F.crc32(F.concat(
        F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = named.select(F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= fewest))


@F.pandas_udf(T.StringType())
def shared_prefix(first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([os.path.commonprefix([a, b]) for a, b in zip(first, last)], dtype=object)


def code_point(text: str, at: Column) -> Column:
    return F.substring(F.col(text), at, F.lit(1))


def build_tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tries of ``words(word, n)`` and of the reversed words.

    Returns the edges ``(side, node, char, child, child_n, words)``, ``child_n`` the count of the
    word that ends at the child (or null) and ``words`` how many go that way, and the
    nodes each word passes, ``(side, word, n, node, node_n)``.
    """
    both = words.withColumn("side", F.lit("f")).unionByName(
        words.select(F.reverse("word").alias("word"), "n", F.lit("r").alias("side")))
    path = settle(both.select("side", "word", "n", F.left("word", F.lit(FIRST)).alias("node"),
                              F.lit(None).cast("bigint").alias("node_n")), "path")
    edges, paths = [], []
    while not path.isEmpty():
        char = code_point("word", F.length("node") + 1).alias("char")
        first = F.min(F.struct("word", "n")).alias("first")
        ways = path.groupBy("side", "node", char).agg(first, F.max("word").alias("last"), F.count(F.lit(1)).alias("words"))
        ways = ways.withColumn("child", shared_prefix(F.col("first.word"), F.col("last"))).select(
            "side", "node", "char", "child", F.when(F.col("first.word") == F.col("child"), F.col("first.n")).alias("child_n"), "words")
        ways = settle(ways, "edges")
        edges.append(ways)
        paths.append(path)
        # a word alone on its edge has arrived
        onward = ways.filter("words > 1").select("side", "node", "char", "child", F.col("child_n").alias("_n"), "words")
        path = lookup_join(path.withColumn("char", char), onward, [*KEYS, "char"], counted="words").filter(
            F.length("word") > F.length("child"))
        path = settle(path.select("side", "word", "n", F.col("child").alias("node"), F.col("_n").alias("node_n")), "path")
    empty = settle(words.select(F.lit("f").alias("side"), F.col("word").alias("node"), F.col("word").alias("char"),
                                F.col("word").alias("child"), F.col("n").alias("child_n"), F.col("n").alias("words")).limit(0), "edges")
    return union([*edges, empty]), union([*paths, path])


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: all ordered pairs of ``words(word, n)`` at exactly one inserted, deleted or
    replaced code point, once each. ``word`` is unique."""
    edges, path = build_tries(words)
    edges = settle(edges, "trie")
    # at most one child per code point of the alphabet
    nodes = edges.groupBy(*KEYS).agg(F.collect_list(F.struct("char", "child", "child_n", "words")).alias("children"),
                                     F.sum("words").alias("passing"))
    depth, size = F.length("node"), F.length("word")
    half = F.floor(size / 2)
    # an edit in the second half parts below it; one in the first half leaves the second as it is
    open_ = path.filter(depth >= F.when(F.col("side") == "f", half).otherwise(size - half))
    # the last code point deleted: the word's own path ends in the neighbour
    ends = open_.filter((size == depth + 1) & F.col("node_n").isNotNull()).select(
        "side", "word", "n", F.col("node").alias("near"), F.col("node_n").alias("near_n"))
    moved = lookup_join(open_, nodes, KEYS, counted="passing").select(
        "side", "word", "n", "node", F.explode("children").alias("to"))
    label = F.length("to.child") - depth
    own = code_point("word", depth + 1)

    def reads(text: str, start: Column, length: Column) -> Column:
        return F.substring(F.col(text), start, length)

    # insertions are deletions seen from the longer word, replacements are met by the larger code point only
    replaced = (F.col("to.char") < own) & (reads("word", depth + 2, label - 1) == reads("to.child", depth + 2, label - 1))
    deleted = (F.col("to.char") != own) & (reads("word", depth + 2, label) == reads("to.child", depth + 1, label))
    edited = moved.select("*", F.filter(F.array(F.when(replaced, 0), F.when(deleted, 1)), lambda s: s.isNotNull()).alias("kinds"))
    states = edited.select("side", "word", "n", F.explode("kinds").alias("shift"), F.col("to.child").alias("node"),
                           F.col("to.child_n").alias("node_n"), F.col("to.words").alias("words"))
    found = [ends]
    while True:
        # a state stands at code point ``length(node) + shift`` of its word, with one edit made
        states = settle(states.filter((size > depth + F.col("shift")) & (F.col("words") > 1)
                                      | (size == depth + F.col("shift")) & F.col("node_n").isNotNull()), "states")
        if states.isEmpty():
            break
        over = size == depth + F.col("shift")
        found.append(states.filter(over).select("side", "word", "n", F.col("node").alias("near"), F.col("node_n").alias("near_n")))
        going = states.filter(~over).select("side", "word", "n", "shift", "node",
                                            code_point("word", depth + F.col("shift") + 1).alias("char"))
        onward = edges.select(*KEYS, "char", "child", F.col("child_n").alias("node_n"), "words")
        onward._stylegraph_written = True       # columns of a written table
        step = F.length("child") - depth
        states = lookup_join(going, onward, [*KEYS, "char"]).filter(
            reads("word", depth + F.col("shift") + 1, step) == reads("child", depth + 1, step)).select(
            "side", "word", "n", "shift", F.col("child").alias("node"), "node_n", "words")
    met = union(found)
    # reversed words: pairs that share the first half were found on the other side
    back = met.filter("side = 'r'").select(F.reverse("word").alias("word"), "n", F.reverse("near").alias("near"), "near_n")
    same = F.left("word", half) == F.left("near", half)
    pairs = met.filter("side = 'f'").drop("side").unionByName(back.filter(~same))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_variants(docs: DataFrame, shortest: int = 7, fewest: int = 2, ratio: int = 10) -> DataFrame:
    """Groups of spelling variants among the words of ``docs(doc_id, text)``.

    Returns ``word, form, root, n, n_near, form_n`` for every word of ``word_counts``. ``form`` is the
    near word with the largest count (ties: the smallest in code-point order) if it occurs at
    least ``ratio`` times as often, else null; ``root`` is where following the forms ends.

    Whole texts of any length are read. A null text has no words, a null id counts as an empty
    one, repeated rows count again; no words give no rows. Long words cost as many
    rounds as words part along them, not as many as they have code points.
    """
    words = settle(word_counts(docs, shortest, fewest), "words")
    near = one_edit_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    chosen = settle(chosen.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                  F.when(fits, F.col("best.near")).alias("form"),
                                  F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    # counts grow tenfold along the forms, so few rounds of doubling reach every root
    links = settle(chosen.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = settle(links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return chosen.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB text of the same result: neighbours by words with one code point left out."""
    return r"""WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
distinct_runs AS MATERIALIZED (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len(bytes), 2),
    lambda i: ('0x' || bytes[i:i + 1])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
    FROM distinct_runs, crc_table),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (
    SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word AS a, h.n AS an, w.word AS b, w.n AS bn FROM holes h JOIN words w ON w.word = h.rest),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY word),
chosen AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
    CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps(word, root, k) AS (SELECT word, form, 1 FROM chosen WHERE form IS NOT NULL
    UNION ALL SELECT s.word, c.form, s.k + 1 FROM steps s JOIN chosen c ON c.word = s.root WHERE c.form IS NOT NULL)
SELECT c.word, c.form, coalesce(s.root, c.word) AS root, c.n, c.n_near, c.form_n FROM chosen c LEFT JOIN (
    SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) s USING (word)"""
