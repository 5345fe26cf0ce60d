"""Mixing sources to target weights by systematic sampling.

Documents of a source are laid on a line, each as long as its expected number of
copies; a random offset shifts the integer marks, and a document is emitted once
for every mark inside its stretch. The line runs by size, so that the words taken
stay within about one document of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stylegraph.llm.common import WORD, hashed_rank, only, stable_hash
from stylegraph.operators.skew import MAX_HOT_BYTES, global_index, lookup_join, number_in_group
from stylegraph.sources.staging import settle


def source_targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3),
                   share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Target size of each source of ``sources(source, source_size)``, one row per source.

    Sources sorted by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes; what exceeds ``max_repeat`` times a source's size is
    dealt out again by weight until nothing does. Adds ``target`` and ``rate``
    (expected copies per document; 0 for a source without words).
    """
    numbered = global_index(sources.withColumn("_last", F.col("source").isNull()),
                            ["_last", "source"], "_pos", small_rows=0).drop("_last")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(numbered.withColumn(
        "weight", F.element_at(listed, (F.col("_pos") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size").cast("double") * max_repeat).drop("_pos"), "sources")
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("_cap") < F.col("weight") * F.lit(level)
        n, full, open_ = table.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not open_:
            break
        level, capped = (total - full) / open_, n
    target = F.least(F.col("_cap"), F.col("weight") * F.lit(level))
    return table.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)).drop("_cap")


def n_words() -> Column:
    """Words of ``text``, 0 for null."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0,
        max_repeat: int = 3, seed: int = 0) -> DataFrame:
    """How often the mix takes each row of ``docs(doc_id, source, text)``.

    Returns ``doc_id, source, size, source_size, target, copies, taken``; size is the
    number of words. A null text has size 0, null sources are one source and come
    last, a null id is an id like any other. Rows that repeat an id are drawn one
    by one. No rows give no rows. The draw depends on ids, sources and sizes only,
    so reruns agree. A source's words differ from its target by less than the size
    of its largest document, as a rule by far less.
    """
    size = n_words()
    digits = F.col("size").cast("string")
    rows = settle(
        only(docs, doc_id="bigint", source="string", text="string")
        .select("doc_id", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"),
                size.alias("size"))
        # sizes that share their first two digits lie together
        .withColumn("_bin", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")), "sizes")
    bins = settle(rows.groupBy("_s", "_null", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "bins")
    source = F.when(~F.col("_null"), F.col("_s"))
    targets = source_targets(bins.groupBy("_s", "_null").agg(F.sum("size").alias("source_size"))
                             .withColumn("source", source), weights, share, max_repeat)
    before = (Window.partitionBy("_s", "_null").orderBy("_bin")
              .rowsBetween(Window.unboundedPreceding, -1))
    places = (bins.select("_s", "_null", "_bin", "n",
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
              .join(targets.drop("weight"), ["_s", "_null"]))
    ranked = hashed_rank(rows, ["_s", "_null", "_bin"], ["doc_id", "size"], "_rank", places)
    offset = F.shiftright(stable_hash(F.lit(seed), F.col("_s")), 28) / F.lit(float(1 << 32))
    place = F.col("_first") + F.col("_rank")
    marks = (F.floor(F.col("rate") * (place + 1) + offset) - F.floor(F.col("rate") * place + offset))
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(marks, F.lit(max_repeat)).cast("bigint").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (from :func:`mix`) says.

    Rows are matched by what the mix sees of them: id, source and size. Rows that agree
    in all three share a rate, so their copies differ by one at most; their sum is dealt
    evenly, one more to the first rows by hash. Numbering those spans tasks. What the mix says
    travels to the texts while it fits in ``MAX_HOT_BYTES``; beyond, the texts are shuffled once.
    """
    names = docs.columns
    alike = ["_id", "_none", "_s", "_null", "_size"]

    def seen(size: Column) -> list[Column]:
        id_ = F.col("doc_id").cast("bigint")
        return [F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_none"),
                F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"),
                size.alias("_size")]

    dealt = settle(mixed.select(*seen(F.col("size")), "copies").groupBy(*alike).agg(
        F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_n")), "dealt")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *seen(n_words()))
    row_bytes = F.octet_length("_s") + 96
    if (dealt.agg(F.sum(row_bytes)).first()[0] or 0) <= MAX_HOT_BYTES:
        joined = left.join(F.broadcast(dealt), alike)       # else every text would go through a shuffle
    else:
        joined = lookup_join(left, dealt, alike, counted="_n")
    times = F.expr("_total div _n")
    uneven = "_total % _n <> 0"
    if dealt.filter(uneven).isEmpty():
        rows = joined.select("_row", times.alias("_times"))
    else:
        odd = settle(joined.filter(uneven).withColumn("_hash", F.xxhash64("_row"))
                     .withColumn("_key", F.monotonically_increasing_id()), "alike")
        ranks = number_in_group(odd.select(*alike, "_hash", "_key"), alike, ["_hash", "_key"], "_rank",
                                small_rows=0).select("_key", "_rank")
        more = odd.join(ranks, "_key").select(
            "_row", (times + F.expr("CASE WHEN _rank < _total % _n THEN 1 ELSE 0 END")).alias("_times"))
        rows = joined.filter(f"NOT {uneven}").select("_row", times.alias("_times")).unionByName(more)
    return (rows.filter("_times > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
