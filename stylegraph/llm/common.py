"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stylegraph.operators.skew import lookup_join

# Words as the contracts define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast; other columns cannot clash with helper names."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def stable_hash(*columns: Column) -> Column:
    """60 bits of an md5 as a long; DuckDB computes the same with ``md5`` and a hex cast."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def groups(column: pa.Array, size: int) -> Iterator[list[str]]:
    """Texts of a column, null as empty, in lists of about ``size`` characters."""
    texts, n = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        n += len(texts[-1])
        if n >= size:
            yield texts
            texts, n = [], 0
    if texts:
        yield texts


def hashed_rank(rows: DataFrame, keys: Sequence[str], ties: Sequence[str], name: str = "rank",
                info: DataFrame | None = None) -> DataFrame:
    """Rank 0.. of each row among the rows with its ``keys``, by hash of ``ties[0]``, then ``ties``.

    A key with n rows is cut into about sqrt(n) hash ranges: one window counts the
    ranges of a key, another numbers the rows of a range, so neither ever holds
    more than about sqrt(n) rows. ``rows`` is read three times and should be a
    written table; ``keys`` must not be null. ``info`` has a row per key with its number of rows
    as ``n`` and columns to bring along; else the rows are counted.
    """
    keys, ties = list(keys), list(ties)
    if info is None:
        info = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cut = lookup_join(rows.withColumn("_h", stable_hash(F.col(ties[0]))),
                      info.withColumnRenamed("n", "_n"), keys, counted="_n")
    # dealt by key and range: by key alone, a crowded key would stay in one task
    cut = cut.withColumn("_range", F.shiftright(
        F.shiftright("_h", 28) * F.ceil(F.sqrt("_n")).cast("bigint"), 32)).drop("_n").repartition(*keys, "_range")
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_h", *ties)
    return (cut.withColumn("_own", F.row_number().over(inside)).join(starts, [*keys, "_range"])
            .withColumn(name, F.col("_start") + F.col("_own") - 1)
            .drop("_h", "_range", "_start", "_own"))
