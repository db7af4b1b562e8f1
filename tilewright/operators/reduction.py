"""Incremental principal components: a decomposition that is updated batch by batch and merged by a tree.

A state stands for all rows that it was given: how many, their mean, and the axes of their scatter, each times its singular value, the largest first. Two states merge by one small decomposition of both's axes and of the step between their means; a task makes
a state of its rows, portion by portion, and states of tasks merge FAN at a time, round by round, so that no task and no message is larger than FAN states. With as many axes as dimensions a state loses nothing and the result is that of all rows at once. With fewer, `lost` adds up the squared
singular values that merges dropped: the scatter along any directions, as the state has it, falls short of the rows' own by `lost` at most, so no other axes of that number explain more than the state's by more than `lost`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators._numbering import numbered
from tilewright.operators._tables import written

STATE = "n bigint, mean array<double>, axes array<array<double>>, lost double"
#: Rows decomposed at once, and states merged at once.
PORTION, FAN = 1024, 16

State = tuple[int, np.ndarray, np.ndarray, float]


def _kept(scatter: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The axes of rows whose products say the scatter, times their singular values, at most so many; and what is lost."""
    _, s, v = np.linalg.svd(scatter, full_matrices=False)
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    return s[:most, None] * v[:most], float((s[most:] ** 2).sum())


def merged(states: list[State], most: int) -> State:
    """One state of several."""
    states = [s for s in states if s[0]]
    if not states:
        return 0, np.empty(0), np.empty((0, 0)), 0.0
    n, mean, axes, lost = states[0]
    for m, other, more, gone in states[1:]:
        step = np.sqrt(n * m / (n + m)) * (mean - other)
        axes, dropped = _kept(np.concatenate([axes, more, step[None]]), most)
        mean, n, lost = (mean * n + other * m) / (n + m), n + m, lost + gone + dropped
    return n, mean, axes, lost


def of_rows(x: np.ndarray, most: int) -> State:
    """The state of a portion of rows."""
    if not len(x):
        return 0, np.empty(0), np.empty((0, 0)), 0.0
    mean = x.mean(0)
    axes, lost = _kept(x - mean, most)
    return len(x), mean, axes, lost


def _frame(state: State) -> pd.DataFrame:
    n, mean, axes, lost = state
    return pd.DataFrame({"n": [n], "mean": [mean.tolist()], "axes": [axes.tolist()], "lost": [lost]})


def _states(rows: pd.DataFrame) -> list[State]:
    """The states of a frame, in an order of their own."""
    rows = rows.assign(_k=[tuple(m) for m in rows["mean"]]).sort_values(["n", "_k"])
    return [(int(r.n), np.array(r.mean, float), np.array([np.array(a, float) for a in r.axes]).reshape(-1, len(r.mean)), float(r.lost)) for r in rows[["n", "mean", "axes", "lost"]].itertuples(index=False)]


def fit(rows: DataFrame, components: int = 50, vector: str = "features", before: DataFrame | None = None) -> DataFrame:
    """The state (one row) of rows, and of those that `before`, a state, stands for, with at most so many components. Rows without a vector don't count; without any row there is no state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: State = (0, np.empty(0), np.empty((0, 0)), 0.0)
        for whole in batches:
            for part in (whole.slice(s, PORTION) for s in range(0, whole.num_rows, PORTION)):
                vectors = part.column(0).drop_null()
                if len(vectors):
                    now = merged([now, of_rows(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), components)], components)
        if now[0]:
            yield pa.RecordBatch.from_pandas(_frame(now), schema=_SCHEMA, preserve_index=False)

    states = rows.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, STATE)
    return together(states if before is None else states.unionByName(before.select("n", "mean", "axes", "lost")), components)


_SCHEMA = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("axes", pa.list_(pa.list_(pa.float64()))), ("lost", pa.float64())])


def together(states: DataFrame, components: int = 50) -> DataFrame:
    """One state of all, merged FAN at a time."""
    states = written(states, "reduction")
    many = states.count()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(merged(_states(rows), components))

    while many > 1:
        placed = numbered(states, ["n", "mean"], "g").withColumn("g", F.floor(F.col("g") / FAN))
        states = written(placed.groupBy("g").applyInPandas(merge, STATE), "reduction")
        many = states.count()
    return states


def partial_fit(state: DataFrame | None, batch: DataFrame, components: int = 50, vector: str = "features") -> DataFrame:
    """The state after one more batch. It is a table, to be saved between batches."""
    return fit(batch, components, vector, state)


def model(state: DataFrame, components: int | None = None) -> DataFrame:
    """(component, weights, shift, scale) for models.apply_reduction: unit axes, the largest weight of each positive, the mean along each and the population deviation. At most so many of the state's components; axes without any deviation go."""
    row = state.first()
    schema = "component int, weights array<double>, shift double, scale double"
    if row is None:
        return state.sparkSession.createDataFrame([], schema)
    axes, mean = np.array(row.axes, float), np.array(row.mean, float)
    s = np.sqrt((axes**2).sum(1))
    keep = np.flatnonzero(s > 1e-12 * max(1.0, s.max(initial=0.0)))[:components]
    made = [(k, (axes[i] / s[i]).tolist(), float(mean @ axes[i] / s[i]), float(s[i] / np.sqrt(row.n))) for k, i in enumerate(keep)]
    return state.sparkSession.createDataFrame(made, schema)
