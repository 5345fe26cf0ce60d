"""Answering generation requests as they arrive, each distinct one only once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stylegraph.operators.hooks import Generator, generate_text
from stylegraph.sources.documents import resume_pending
from stylegraph.sources.staging import is_written

KEYS = ["instruction", "input"]


def answer_pending(requests: DataFrame, path: str, generate: Generator) -> None:
    """Append the answers of requests that have none at ``path`` yet."""
    spark = requests.sparkSession
    wanted = requests.select(*KEYS).distinct()
    if is_written(spark, path):
        wanted = resume_pending(wanted, spark.read.parquet(path), KEYS)
    generate_text(wanted, generate).write.mode("append").parquet(path)


def answer_stream(requests: DataFrame, path: str, checkpoint: str,
                  generate: Generator) -> StreamingQuery:
    """Run ``answer_pending`` on every micro-batch of a streaming DataFrame.

    A batch replayed after a failure finds its answers written and adds nothing.
    """
    return (requests.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, _: answer_pending(batch, path, generate)).start())
