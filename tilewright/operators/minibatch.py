"""Mini-batch k-means: a state table of centres with their counts, updated batch by batch, from tables or from a stream.

An update gives each row of a batch to its nearest centre (the lower id of equals) and moves each centre to the mean of all rows that it was ever given. What a batch adds, sums and counts a centre, is added up in each task first
and then over tasks, so that sums of parts of a batch, wherever they were made, add up to the batch's. A batch without rows, or a null vector, changes nothing; a centre that is given nothing stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructType

from tilewright.operators._tables import removed, written
from tilewright.operators.cluster import _least

STATE = "id bigint, features array<double>, weight double"
SUMS = "id bigint, n bigint, total array<double>"
#: Rows that the first centres are chosen from, at most.
SAMPLE = 8192


def initial(rows: DataFrame, k: int, seed: int = 7, sample: int = SAMPLE, vector: str = "features") -> DataFrame:
    """k first centres (id, features, weight 0) out of the rows of least hash, at most so many: each next one drawn with a chance that grows with the square of its distance to the nearest before it. Fewer where there are fewer different rows."""
    own = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("features"))
    drawn = own.orderBy(F.xxhash64("features", F.lit(seed)), "features").limit(sample)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, group["features"])), float)
        dice = np.random.default_rng(seed)
        taken = [int(dice.integers(len(x)))]
        far = ((x - x[taken[0]]) ** 2).sum(1)
        while len(taken) < k and far.max() > 0:
            taken.append(int(np.searchsorted(np.cumsum(far), dice.random() * far.sum(), "right").clip(0, len(x) - 1)))
            far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(1))
        return pd.DataFrame({"id": range(len(taken)), "features": x[taken].tolist(), "weight": 0.0})

    return written(drawn.groupBy(F.lit(0).alias("_g")).applyInPandas(choose, STATE), "centres")


def _table(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The centres' ids and vectors, in the order of ids. They are few: a parameter says how many."""
    rows = sorted((r.id, r.features) for r in state.select("id", "features").collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a vector, and their vectors."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return there, column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), size)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's nearest centre, the first of equals, and its distance."""
    row, at, apart = _least(x, centres, 1)
    order = np.lexsort((at, apart, row))
    first = order[np.flatnonzero(np.append(True, np.diff(row[order]) > 0))]
    return at[first], apart[first]


def sums(state: DataFrame, batch: DataFrame, vector: str = "features") -> DataFrame:
    """(id, n, total): how many rows of a batch each centre is given, and their sum. Sums of a batch's parts may be united and added up."""
    ids, centres = _table(state)
    sent = batch.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for whole in batches:
            for part in (whole.slice(s, 1024) for s in range(0, whole.num_rows, 1024)):
                _, x = _vectors(part.column(0), c.shape[1])
                if len(x):
                    at, _ = _nearest(x, c)
                    n += np.bincount(at, minlength=len(c))
                    np.add.at(total, at, x)
        given = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[given]), pa.array(n[given]), pa.array(total[given].tolist(), pa.list_(pa.float64()))], names=["id", "n", "total"])

    return added(batch.select(F.col(vector).cast("array<double>").alias("features")).mapInArrow(run, SUMS))


def added(parts: DataFrame) -> DataFrame:
    """One (id, n, total) a centre of many: a row a task and centre, so few."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(sorted(map(tuple, group["total"])), float)
        return pd.DataFrame({"id": [group["id"].iloc[0]], "n": [group["n"].sum()], "total": [rows.sum(0).tolist()]})

    return parts.groupBy("id").applyInPandas(add, SUMS)


def moved(state: DataFrame, given: DataFrame) -> DataFrame:
    """state with each centre moved to the mean of all rows it was given, those of `given` included."""
    n = F.coalesce("n", F.lit(0))
    mean = F.zip_with("features", "total", lambda f, t: (f * F.col("weight") + t) / (F.col("weight") + F.col("n")))
    return state.join(given, "id", "left").select("id", F.when(n > 0, mean).otherwise(F.col("features")).alias("features"), (F.col("weight") + n).alias("weight"))


def partial_fit(state: DataFrame, batch: DataFrame, vector: str = "features") -> DataFrame:
    """The state after a batch, as a table."""
    return written(moved(state, sums(state, batch, vector)), "centres")


def fit(rows: DataFrame, state: DataFrame, batch: str, vector: str = "features") -> DataFrame:
    """The state after all batches, in the order of the column that says which batch a row is of. Rows of a null batch are of none."""
    for number in sorted(r[0] for r in rows.select(batch).distinct().where(F.col(batch).isNotNull()).collect()):
        state = partial_fit(state, rows.where(F.col(batch) == number), vector)
    return state


def merged(states: list[DataFrame]) -> DataFrame:
    """One state of several with the same ids, each fitted on rows of its own: the mean of each centre by its weights, or plainly where all weights are zero."""
    rows = reduce(DataFrame.unionByName, states).select("id", "weight", F.posexplode("features").alias("pos", "v"))
    share = F.when(F.col("w") > 0, F.col("wv") / F.col("w")).otherwise(F.col("mean"))
    flat = rows.groupBy("id", "pos").agg(F.sum(F.col("weight") * F.col("v")).alias("wv"), F.sum("weight").alias("w"), F.avg("v").alias("mean")).select("id", "pos", "w", share.alias("v"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return flat.groupBy("id").agg(whole.alias("features"), F.max("w").alias("weight"))


def predict(rows: DataFrame, state: DataFrame, vector: str = "features") -> DataFrame:
    """rows with label and d, the nearest centre's id and its distance; null for a null vector."""
    ids, centres = _table(state)
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kept = rows.drop("label", "d")
    at = kept.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for part in (whole.slice(s, 1024) for s in range(0, whole.num_rows, 1024)):
                there, x = _vectors(part.column(at), c.shape[1])
                label, d, none = np.zeros(len(part), np.int64), np.zeros(len(part)), np.ones(len(part), bool)
                if len(x):
                    near, far = _nearest(x, c)
                    label[there], d[there], none[there] = ids[near], far, False
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, mask=none), pa.array(d, mask=none)], names=[*part.schema.names, "label", "d"])

    schema = StructType([*kept.schema.fields, *StructType().add("label", LongType()).add("d", DoubleType()).fields])
    return kept.mapInArrow(run, schema)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state that a stream left."""
    states = spark.read.schema(f"{STATE}, version bigint").parquet(path)
    newest = states.agg(F.max("version")).first()[0]
    return states.where(F.col("version") == newest).drop("version")


def update(path: str, start: DataFrame, batch: DataFrame, version: int, vector: str = "features") -> None:
    """Writes the state after a stream's batch as the version of that number, from the one before it (or from start). A batch that is tried again writes the same version again, so each counts once. Versions before the last but one go."""
    spark = batch.sparkSession
    before = spark.read.schema(STATE).parquet(f"{path}/version={version - 1}") if version else start
    partial_fit(before, batch, vector).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    if version > 1:
        removed(spark, f"{path}/version={version - 2}")


def fit_stream(stream: DataFrame, start: DataFrame, path: str, checkpoint: str, vector: str = "features") -> StreamingQuery:
    """Updates the state with each batch of a stream. The state after a batch depends on the one before and on the batch alone, so it ends as fit() does over the same batches, also after a restart from the checkpoint."""
    start = written(start, "centres")
    return stream.writeStream.foreachBatch(lambda batch, number: update(path, start, batch, number, vector)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
