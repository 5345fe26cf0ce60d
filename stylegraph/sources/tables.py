"""Reading Parquet tables so that every core has work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when the scan has fewer tasks than there are cores.

    A table of many files or row groups is left alone; a single small file would
    otherwise be processed by one task. Filters and column pruning still reach
    the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
