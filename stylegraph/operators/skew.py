"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from stylegraph.sources.staging import settle

# A key is hot from this many rows on; below it a single task copes easily.
HOT_ROWS = 1_000_000
# Upper bounds on hot keys and on the bytes of their rows, hence on the broadcast that serves them.
MAX_HOT_KEYS = 50_000
MAX_HOT_BYTES = 64 << 20
# Rows one task may number on its own.
SMALL_ROWS = 100_000


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
                counted: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to a table holding at most one row per key.

    The lookup is written first: then both sides of the join come straight from
    an exchange and adaptive execution splits a skewed key by itself, or
    broadcasts the lookup when its measured size allows.

    ``counted`` names a lookup column that tells how many rows each key has. Keys
    above ``threshold`` are then split off: as their counts add up to the total,
    there are at most ``total / threshold`` of them, a known size to broadcast.
    """
    lookup = settle(lookup, "lookup")
    if counted is None:
        return rows.join(lookup, keys, how)
    # flat columns are taken as 32 bytes each, lists by their longest
    lists = [f.name for f in lookup.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    total, largest, *longest = lookup.agg(F.sum(counted), F.max(counted), *[
        F.max(F.size(F.col(f"`{c}`"))) for c in lists]).first()
    row_bytes = 32 * len(lookup.columns) + 16 * sum(max(n or 0, 0) for n in longest)
    threshold = max(hot_rows, (total or 0) // min(MAX_HOT_KEYS, max(MAX_HOT_BYTES // row_bytes, 1)))
    if (largest or 0) <= threshold:
        return rows.join(lookup, keys, how)
    hot = F.broadcast(lookup.filter(F.col(counted) > threshold))
    calm = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(
        calm.join(lookup.filter(F.col(counted) <= threshold), keys, how))


def word_join(rows: DataFrame, lookup: DataFrame, key: str, counted: str | None = None) -> DataFrame:
    """:func:`lookup_join` by one column; a lookup of at most ``MAX_HOT_BYTES`` travels with the tasks instead of ``rows``."""
    lookup = settle(lookup, "lookup")
    size = F.octet_length(F.col(f"`{key}`").cast("string")) + 64
    if (lookup.agg(F.sum(size)).first()[0] or 0) <= MAX_HOT_BYTES:
        return rows.join(F.broadcast(lookup), [key])
    return lookup_join(rows, lookup, [key], counted=counted)


def global_index(df: DataFrame, order: list[str], name: str = "idx",
                 small_rows: int = SMALL_ROWS) -> DataFrame:
    """Number rows 0..n-1 in ``order`` without one task seeing all of a big table.

    Range partitions are sorted locally; a table with one row per partition
    carries the offsets. ``order`` must be unique per row. A table whose count
    is below ``small_rows`` is numbered by a plain window.
    """
    if small_rows and df.count() <= small_rows:
        w = Window.orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint") - 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .withColumn("_mono", F.monotonically_increasing_id())
             .withColumn("_part", F.shiftright("_mono", 33))
             .withColumn("_local", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
             .drop("_mono"))
    local = settle(local, "indexed")
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .drop("_part", "_local", "_offset"))


def number_in_group(df: DataFrame, group: list[str], order: list[str],
                    name: str = "pos", small_rows: int = SMALL_ROWS,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position 0.. of each row inside its group; a huge group spans many tasks."""
    if small_rows and df.count() <= small_rows:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint") - 1)
    indexed = global_index(df, [*group, *order], "_g", small_rows=0)
    indexed = settle(indexed, "numbered")
    starts = indexed.groupBy(*group).agg(F.min("_g").alias("_start"),
                                         F.count(F.lit(1)).alias("_n"))
    return (lookup_join(indexed, starts, group, counted="_n", hot_rows=hot_rows)
            .withColumn(name, F.col("_g") - F.col("_start")).drop("_g", "_start", "_n"))


def in_parts(df: DataFrame, group: list[str], order: list[str], columns: list[str],
             part_rows: int = 1024, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Ordered lists per (group, part), each list at most ``part_rows`` long.

    A small group gives one row; a huge one gives as many as it needs, so no
    group is ever gathered whole.
    """
    numbered = number_in_group(df, group, order, small_rows=small_rows)
    part = F.floor(F.col("pos") / part_rows).cast("bigint").alias("part")
    packed = numbered.select(*group, part, "pos", *columns).groupBy(*group, "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_rows"))
    return packed.select(*group, "part", *[F.col(f"_rows.{c}").alias(c) for c in columns])
