import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with columns whose names the operators use themselves."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOC)
        if extra:
            for name in ("node", "size", "component", "_n", "_h", "kept", "rank", "length", "ids", "spans"):
                from pyspark.sql import functions as F
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make


LONG = "word " * 30_000 + "x" * 50_000
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (None, "two words", "b"),
       (5, "same text here for all of us " * 20, "c"), (6, "same text here for all of us " * 20, "c"),
       (6, "same text here for all of us " * 20, "c"), (7, LONG, "é"), (8, "<|endoftext|> é日😀 \x00", "\U0001F600")]
