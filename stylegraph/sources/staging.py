"""Tables that cut lineage or mark a finished stage.

Everything lands in a folder every executor can reach, so a lost executor only
costs the tasks it was running: readers of a written table never depend on
blocks held by a particular machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there the
    driver and the executors are the same process.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stylegraph-"))
    return context.getCheckpointDir()


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` under the shared folder and return it read back.

    A table that was written here before is returned as it is.
    """
    if getattr(df, "_stylegraph_written", False):
        return df
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stylegraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stylegraph_written = True
    return table


def is_written(spark: SparkSession, path: str) -> bool:
    """True when a finished write (its ``_SUCCESS`` marker) lies at ``path``."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Run a stage once: load its table when finished, else build and write it.

    A half-written folder has no marker and is overwritten.
    """
    if not is_written(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
