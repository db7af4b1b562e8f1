"""Nearest neighbours by a tree of pivots.

Equal vectors are one kind, kept once with its lowest ids. Kinds fall to the nearest of some of them, the pivots of their cell; a cell with too many is split again by pivots of its own, so that no cell outgrows a task however many points there are.
The k nearest in a kind's own cell bound how far its neighbours may be; by the triangle inequality it goes down only to cells that reach so near, level by level, and meets their kinds there. Both sides of each meeting are dealt out in
portions, so a cell that many ask for is many small tasks. The result is exact; how many cells are asked depends on the vectors: in many dimensions, where all distances are alike, nearly all of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.vectors import distance
from tilewright.operators._numbering import numbered
from tilewright.operators._tables import written

#: Kinds of a cell, at most; pivots of a cell, about at most; kinds of a portion; and distances that a task works out at once.
CELL, FAN, PORTION, AT_ONCE = 2048, 256, 8192, 1 << 15
#: Kinds times cells below, of a portion that goes down a level: each may go to each, with its vector.
ASKED = 1 << 15
FAR = np.iinfo(np.int64).max


def nearest_in(own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of others to each vector, itself left out: distances (infinite where there are fewer) and ids, the lower of equals first."""
    best_d, best_i = np.full((len(own), k), np.inf), np.full((len(own), k), FAR)
    step = max(1, AT_ONCE // max(1, len(ids)))
    for at in range(0, len(own), step):
        d = np.sqrt(((vectors[at : at + step, None] - others[None]) ** 2).sum(2))
        d[own[at : at + step, None] == ids[None]] = np.inf
        if d.shape[1] > 4 * k:
            # Ties with the k-th distance stay, so that ids decide among them.
            edge = np.partition(d, k - 1, axis=1)[:, k - 1]
            wide = max(k, int((d <= edge[:, None]).sum(1).max()))
            near = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        else:
            near = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        found = np.take_along_axis(d, near, 1)
        order = np.lexsort((ids[near], found), axis=1)[:, :k]
        n = order.shape[1]
        best_d[at : at + step, :n], best_i[at : at + step, :n] = np.take_along_axis(found, order, 1), ids[np.take_along_axis(near, order, 1)]
    return best_d, best_i


def _none(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: [] for n in names}, dtype=object)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _portions(rows: DataFrame, counts: DataFrame, cell: str, most: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """rows dealt out within their cell, in portions of about PORTION, or most, and (cell, portions)."""
    many = counts.select(cell, F.ceil(F.col("n") / (F.lit(PORTION) if most is None else most)).cast("int").alias("portions"))
    return rows.join(many, cell).withColumn("portion", F.pmod(F.xxhash64("id"), F.col("portions")).cast("int")).drop("portions"), many


def _given_to_all(rows: DataFrame, many: DataFrame, cell: str) -> DataFrame:
    """rows once for each portion of their cell."""
    return rows.join(many, cell).withColumn("portion", F.explode(F.expr("sequence(0, portions - 1)"))).drop("portions")


def pivot_tree(kinds: DataFrame, cell: int = CELL, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """levels of nodes (cell, parent, features, radius, n, leaf) below the root 0, and the kinds (id, features, cell, d) of leaves, with their distance to the leaf's pivot."""
    now = written(kinds.select("id", "features", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("d")), "cells")
    counts = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    levels, leaves, first = [], [], 1
    if now.count() <= cell:
        return [], now
    while True:
        full = written(counts, "cells")
        if full.isEmpty():
            return levels, reduce(DataFrame.unionByName, leaves)
        over = now.join(full, "cell")
        # A cell's pivots: those of its kinds whose hash says so, about as many as halves of a cell would hold; at least two differ, or the next level draws others.
        share = F.least(F.lit(float(fan)), F.ceil(2 * F.col("n") / cell)) / F.col("n")
        dice = F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(1 << 30)) / float(1 << 30)
        lowest = over.groupBy("cell").agg(F.min(F.struct(F.xxhash64("id", F.lit(len(levels))).alias("h"), "id")).alias("m")).select(F.col("m.id").alias("id"))
        drawn = over.where(dice < share).select("id").unionByName(lowest).distinct()
        pivots = written(numbered(over.join(drawn, "id", "left_semi").select("cell", "id", "features"), ["cell", "id"], "_n").select(F.col("cell").alias("parent"), (F.col("_n") + first).alias("to"), "features"), "pivots")
        dealt, many = _portions(over.select("id", "features", "cell"), full, "cell")
        sent = _given_to_all(pivots.withColumnRenamed("parent", "cell"), many, "cell")

        def place(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return _none("id", "features", "parent", "cell", "d")
            around = around.sort_values("to")
            x, c = _matrix(rows["features"]), _matrix(around["features"])
            at, d = np.empty(len(x), np.int64), np.empty(len(x))
            step = max(1, AT_ONCE // len(c))
            for s in range(0, len(x), step):
                apart = np.sqrt(((x[s : s + step, None] - c[None]) ** 2).sum(2))
                at[s : s + step], d[s : s + step] = apart.argmin(1), apart.min(1)
            return pd.DataFrame({"id": rows["id"], "features": rows["features"], "parent": rows["cell"], "cell": around["to"].to_numpy()[at], "d": d})

        schema = "id bigint, features array<double>, parent bigint, cell bigint, d double"
        placed = written(dealt.groupBy("cell", "portion").cogroup(sent.groupBy("cell", "portion")).applyInPandas(place, schema), "cells")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
        nodes = pivots.withColumnRenamed("to", "cell").join(sizes, "cell").select("cell", "parent", "features", "radius", "n", ((F.col("n") <= cell) | (F.col("radius") == 0) | F.isnan("radius")).alias("leaf"))
        levels.append(written(nodes, "nodes"))
        first += pivots.count()
        # Kinds so near that their distance is 0 in a double can't be told apart: their cell stays as it is.
        counts = levels[-1].where("not leaf").select("cell", "n")
        leaves.append(placed.join(levels[-1].where("leaf").select("cell"), "cell", "left_semi").select("id", "features", "cell", "d"))
        now = placed.select("id", "features", "cell", "d")


def knn_edges(points: DataFrame, k: int = 4, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """(a, b, w), a < b: each point (id, features) and its k nearest others, exactly; the lower id wins a tie. Points without a vector have no neighbours."""
    rows = written(points.where(F.col("features").isNotNull()).select(F.col("id").cast("long").alias("id"), "features"), "points")
    # Of equal vectors the lowest ids are enough: a task keeps so many of what it has.
    low = rows.withColumn("_r", F.row_number().over(Window.partitionBy("features").orderBy("id"))).where(F.col("_r") <= k + 1)
    low = low.groupBy("features").agg(F.array_sort(F.collect_list("id")).alias("low"))
    counts = rows.groupBy("features").agg(F.count(F.lit(1)).alias("copies"))
    kinds = written(low.join(counts, "features").select(F.element_at("low", 1).alias("id"), "features", "low", "copies"), "kinds")
    levels, leaves = pivot_tree(kinds, cell, fan)
    leaves = written(leaves.join(kinds.select("id", (F.col("copies") <= k).alias("asks")), "id"), "leaves")

    def inside(own: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = own["id"].to_numpy(np.int64), _matrix(own["features"])
        ask = own["asks"].to_numpy(bool)
        if not ask.any():
            return _none("id", "features", "cell", "near", "near_d", "reach")
        d, i = nearest_in(ids[ask], vectors[ask], ids, vectors, k)
        return own.loc[ask, ["id", "features", "cell"]].assign(near=list(i), near_d=list(d), reach=d[:, -1])

    local = "id bigint, features array<double>, cell bigint, near array<bigint>, near_d array<double>, reach double"
    asked = written(leaves.groupBy("cell").applyInPandas(inside, local), "local")
    found = [asked.select("id", "near", "near_d")]
    if levels:
        every = written(reduce(DataFrame.unionByName, levels), "nodes")
        found.append(_elsewhere(_bounded(asked, every, k), levels, leaves, k))
    near = reduce(DataFrame.unionByName, found).select("id", F.explode(F.arrays_zip("near", "near_d")).alias("z")).where(F.col("z.near_d") < float("inf")).select("id", F.col("z.near").alias("kind"), F.col("z.near_d").alias("w"))
    # The k nearest kinds hold the k nearest points.
    spelt = near.join(kinds.select(F.col("id").alias("kind"), "low"), "kind").select("id", "w", F.explode("low").alias("other"))
    best = spelt.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("w", "other"))), 1, k).alias("best"))
    single = best.join(kinds.where("copies = 1").select("id"), "id", "left_semi")
    # Of a kind with copies, each point has the lowest of the others first.
    copies = kinds.where("copies > 1").join(best, "id", "left").select("features", "low", "best")
    zero = F.transform(F.filter("low", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("w"), i.alias("other")))
    several = rows.join(copies, "features").select("id", F.slice(F.concat(zero, F.coalesce("best", F.array().cast("array<struct<w double, other bigint>>"))), 1, k).alias("best"))
    links = single.unionByName(several).select("id", F.explode("best").alias("e")).select("id", "e.other", "e.w")
    return links.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("w").alias("w"))


def _bounded(asked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, features, cell, reach), with a finite reach also for kinds of a cell too small to bound it: cells beside it, the nearest first by their farthest points, hold k others within it."""
    open_ = asked.where("reach = double('inf')").join(nodes.select("cell", "parent"), "cell")
    beside = open_.join(nodes.select("parent", F.col("features").alias("pivot"), "radius", "n"), "parent").select("id", (distance(F.col("features"), F.col("pivot")) + F.col("radius")).alias("far"), "n")
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    enough = beside.withColumn("_n", upto).where(F.col("_n") > k).groupBy("id").agg(F.min("far").alias("_far"))
    return written(asked.join(enough, "id", "left").select("id", "features", "cell", F.least("reach", F.coalesce("_far", F.lit(float("inf")))).alias("reach")), "reaches")


def _elsewhere(asked: DataFrame, levels: list[DataFrame], leaves: DataFrame, k: int) -> DataFrame:
    """(id, near, near_d): the k nearest in each other leaf that a kind's reach touches."""
    front = asked.select("id", "features", "reach", F.col("cell").alias("own"), F.lit(0).cast("long").alias("cell"))
    ends = []
    for level in levels:
        # What a portion sends on is bounded, however many cells there are below.
        fans = level.groupBy(F.col("parent").alias("cell")).agg(F.count(F.lit(1)).alias("fan"))
        counts = front.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(fans, "cell")
        dealt, many = _portions(front, counts, "cell", F.least(F.lit(PORTION), F.ceil(F.lit(ASKED) / F.col("fan"))))
        sent = _given_to_all(level.select(F.col("parent").alias("cell"), F.col("cell").alias("to"), F.col("features").alias("pivot"), "radius"), many, "cell")

        def go(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(around):
                return _none("id", "features", "reach", "own", "cell")
            x, c, r = _matrix(rows["features"]), _matrix(around["pivot"]), around["radius"].to_numpy()
            out = []
            for s in range(0, len(x), step := max(1, AT_ONCE // len(c))):
                apart = np.sqrt(((x[s : s + step, None] - c[None]) ** 2).sum(2))
                # A little slack, as distances are rounded.
                row, to = np.nonzero(apart - r[None] <= rows["reach"].to_numpy()[s : s + step, None] * (1 + 1e-9) + 1e-9)
                out.append(rows.iloc[s + row].drop(columns=["cell", "portion"]).assign(cell=around["to"].to_numpy()[to]))
            return pd.concat(out)[["id", "features", "reach", "own", "cell"]]

        schema = "id bigint, features array<double>, reach double, own bigint, cell bigint"
        went = written(dealt.groupBy("cell", "portion").cogroup(sent.groupBy("cell", "portion")).applyInPandas(go, schema), "asked")
        ended = level.where("leaf").select("cell")
        ends.append(went.where("own <> cell").join(ended, "cell", "left_semi").select("id", "features", "cell"))
        front = went.join(ended, "cell", "left_anti")
    touched = reduce(DataFrame.unionByName, ends)
    dealt, many = _portions(touched, touched.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")
    held = _given_to_all(leaves.select("id", "features", "cell"), many, "cell")

    def meet(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return _none("id", "near", "near_d")
        d, i = nearest_in(rows["id"].to_numpy(np.int64), _matrix(rows["features"]), own["id"].to_numpy(np.int64), _matrix(own["features"]), k)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "near": list(i), "near_d": list(d)})

    return dealt.groupBy("cell", "portion").cogroup(held.groupBy("cell", "portion")).applyInPandas(meet, "id bigint, near array<bigint>, near_d array<double>")
