"""Watching a training run: how near the vectors of each class are to each other, and classes to other classes, as batches arrive.

The state is a row a class: how many unit vectors it had, and their sum. As the mean of 1 - u.c over unit vectors u with mean c is 1 - c.c, distances within and between classes follow from it, and are those of all batches at once.
The state after a batch, and the distances after every so many batches, are written under the batch's number; a batch that is tried again writes the same again. Vectors that are null, empty or of length 0 don't count, nor do rows without a class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.functions.vectors import dot, mean_vectors, norm, unit
from tilewright.operators._tables import removed, written

STATE = "class string, n bigint, total array<double>"


def sums(batch: DataFrame, label: str = "label", vector: str = "features") -> DataFrame:
    """(class, n, total) of a batch."""
    have = batch.where(F.col(label).isNotNull() & (F.size(vector) > 0)).where(norm(F.col(vector)) > 0)
    units = have.select(F.col(label).cast("string").alias("class"), unit(F.col(vector)).alias("features"))
    means = mean_vectors(units, ["class"])
    return means.select("class", F.col("population").alias("n"), F.transform("features", lambda v: v * F.col("population")).alias("total"))


def added(state: DataFrame, more: DataFrame) -> DataFrame:
    """One state of two."""
    other = more.select("class", F.col("n").alias("_n"), F.col("total").alias("_total"))
    both = F.when(F.col("total").isNull(), F.col("_total")).when(F.col("_total").isNull(), F.col("total")).otherwise(F.zip_with("total", "_total", lambda a, b: a + b))
    return state.join(other, "class", "full").select("class", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), both.alias("total"))


def cosines(state: DataFrame) -> DataFrame:
    """(a, b, distance), a <= b: within a class where they are equal, else between two. Classes are few."""
    means = state.where("n > 0").select("class", F.transform("total", lambda v: v / F.col("n")).alias("c"))
    own = means.select(F.col("class").alias("a"), F.col("class").alias("b"), (1 - dot(F.col("c"), F.col("c"))).alias("distance"))
    left, right = means.select(F.col("class").alias("a"), F.col("c").alias("ca")), means.select(F.col("class").alias("b"), F.col("c").alias("cb"))
    return own.unionByName(left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", (1 - dot(F.col("ca"), F.col("cb"))).alias("distance")))


def over(batches: list[DataFrame], label: str = "label", vector: str = "features") -> DataFrame:
    """The state after batches that are tables."""
    return reduce(lambda state, batch: written(added(state, sums(batch, label, vector)), "monitor"), batches[1:], written(sums(batches[0], label, vector), "monitor"))


def update(path: str, batch: DataFrame, version: int, every: int = 100, label: str = "label", vector: str = "features") -> None:
    """Writes the state after a stream's batch, and after batches 0, every, 2 every ... the distances."""
    spark, state = batch.sparkSession, sums(batch, label, vector)
    if version:
        state = added(spark.read.schema(STATE).parquet(f"{path}/state/version={version - 1}"), state)
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version}")
    if version % every == 0:
        cosines(spark.read.schema(STATE).parquet(f"{path}/state/version={version}")).coalesce(1).write.mode("overwrite").parquet(f"{path}/distances/batch={version}")
    if version > 1:
        removed(spark, f"{path}/state/version={version - 2}")


def watch(stream: DataFrame, path: str, checkpoint: str, every: int = 100, label: str = "label", vector: str = "features") -> StreamingQuery:
    """Watches a stream of vectors with their classes."""
    return stream.writeStream.foreachBatch(lambda batch, number: update(path, batch, number, every, label, vector)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, path: str) -> DataFrame:
    """(batch, a, b, distance): what was seen so far."""
    return spark.read.schema("a string, b string, distance double, batch bigint").parquet(f"{path}/distances").select("batch", "a", "b", "distance")
