"""Dense vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    # the length is bound once per row, not computed again for every element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(
        n > 0, F.transform(a, lambda x: x / n)).otherwise(a))
    return F.get(scaled, F.lit(0))


def rescale_unit(a: Column) -> Column:
    """Map cosine-like values from [-1, 1] to [0, 1]."""
    return F.transform(a, lambda x: (x + 1.0) / 2.0)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_mean(vector: Column) -> Column:
    """Element-wise mean of a group; partial sums are formed before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def vector_sum(vector: Column) -> Column:
    """Element-wise sum of a group."""
    return vector_to_array(Summarizer.sum(array_to_vector(vector)))


def clean(value: Column, digits: int = 6) -> Column:
    """Round for comparison and turn -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
