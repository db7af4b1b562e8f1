"""Expressions over vectors held as array<double>. All stay in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """a over its length, which is worked out once."""
    return F.element_at(F.transform(F.array(norm(a)), lambda length: F.transform(a, lambda x: F.try_divide(x, length))), 1)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(a: Column) -> Column:
    """Shifted by the largest value, so that nothing overflows."""
    powers = F.element_at(F.transform(F.array(F.array_max(a)), lambda top: F.transform(a, lambda x: F.exp(x - top))), 1)
    return F.element_at(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / _sum(p))), 1)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "features") -> DataFrame:
    """(keys, population, vector): the mean by key, from partial aggregates of whole vectors, so that a row stays one row and a group of any size costs a task one array. Rows without a vector don't count. All vectors have one length."""
    have = rows.where(F.size(vector) > 0).select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    means = have.groupBy(*keys).agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s"))
    return means.select(*keys, F.col("_s.count").alias("population"), vector_to_array("_s.mean").alias(vector))


def weighted_mean(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """The mean of two means by their populations."""
    return F.zip_with(a, b, lambda x, y: (x * n_a + y * n_b) / (n_a + n_b))
