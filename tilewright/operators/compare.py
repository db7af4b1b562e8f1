"""Comparison of clusterings of the same tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators._tables import written


def cluster_sizes(rows: DataFrame, label: str = "c1") -> DataFrame:
    """(cluster, n) for 0 to the largest label, empty ones included."""
    counts = rows.where(F.col(label) >= 0).groupBy(F.col(label).cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.max("cluster").alias("m")).where("m is not null").select(F.explode(F.expr("sequence(0, m)")).alias("cluster"))
    return every.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, a, b): the labels of the tiles that both clusterings have."""
    return a.select(*keys, F.col(label).alias("a")).join(b.select(*keys, F.col(label).alias("b")), keys)


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def overlap(pairs: DataFrame, dense: bool = True) -> DataFrame:
    """(a, b, n, of_union, of_a, of_b): shared tiles of each two clusters, and their percentages; null where a cluster is empty. dense: every pair of labels up to the largest is there, which is a grid of labels; else those that share tiles."""
    # Written, so that the tiles are counted once: all that follows reads the small table of clusters.
    cells = written(contingency(pairs), "cells")
    n_a, n_b = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in "ab")
    if dense:
        top = cells.agg(F.max(F.greatest("a", "b")).alias("top")).where("top is not null")
        grid = top.select("top", F.explode(F.expr("sequence(0, top)")).alias("a")).select("a", F.explode(F.expr("sequence(0, top)")).alias("b"))
        cells = grid.join(cells, ["a", "b"], "left")
    cells = cells.join(n_a, "a", "left").join(n_b, "b", "left").select("a", "b", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "n_a", "n_b")))

    def percent(of: object) -> object:
        return F.try_divide(F.lit(100.0) * F.col("n"), of)

    return cells.select("a", "b", "n", percent(F.col("n_a") + F.col("n_b") - F.col("n")).alias("of_union"), percent(F.col("n_a")).alias("of_a"), percent(F.col("n_b")).alias("of_b"))


def best_matches(overlaps: DataFrame, by: str = "of_union", cluster: str = "a", other: str = "b") -> DataFrame:
    """(cluster, match, percent): for each cluster the other one with the largest percentage; the lowest of equals."""
    at = Window.partitionBy(cluster).orderBy(F.col(by).desc_nulls_last(), other)
    return overlaps.withColumn("_r", F.row_number().over(at)).where("_r = 1").select(F.col(cluster).alias("cluster"), F.col(other).alias("match"), F.col(by).alias("percent"))


def rand_index(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ari): the adjusted Rand index from the contingency table; 1 where both clusterings are trivial alike."""
    keys = keys or []
    # The tiles are counted once; marginals are sums over the small table of clusters, each put on the first of its cells.
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = keys or [F.lit(0)]

    def side(c: str, other: str) -> tuple[object, object]:
        return F.sum("n").over(Window.partitionBy(*whole, c)), F.row_number().over(Window.partitionBy(*whole, c).orderBy(other)) == 1

    (m_a, first_a), (m_b, first_b) = side("a", "b"), side("b", "a")
    cells = cells.select(*keys, "n", F.when(first_a, m_a).alias("m_a"), F.when(first_b, m_b).alias("m_b"))

    def pairs_of(n: str) -> object:
        return F.sum(F.col(n) * (F.col(n) - 1) / 2)

    full = cells.groupBy(*keys).agg(pairs_of("n").alias("p"), F.sum("n").alias("total"), pairs_of("m_a").alias("p_a"), pairs_of("m_b").alias("p_b"))
    full = full.where("total is not null")
    chance = F.try_divide(F.col("p_a") * F.col("p_b"), F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("p_a") + F.col("p_b")) / 2
    return full.select(*keys, F.when(top == chance, 1.0).otherwise((F.col("p") - chance) / (top - chance)).alias("ari"))


def stability(runs: DataFrame, keys: list[str], over: list[str] | None = None) -> DataFrame:
    """(over, mean_ari, sd_ari, pairs): agreement of every two runs. runs: (keys, run, label), and over, such as the number of clusters. Runs meet tile by tile, so the rows made are tiles times pairs of runs."""
    over = over or []
    per_tile = runs.groupBy(*over, *keys).agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("r"))
    two = per_tile.select(*over, F.explode(F.flatten(F.transform("r", lambda p: F.transform(F.filter("r", lambda q: q["run"] > p["run"]), lambda q: F.struct(p["run"].alias("i"), q["run"].alias("j"), p["label"].alias("a"), q["label"].alias("b")))))).alias("x"))
    found = rand_index(two.select(*over, "x.*"), [*over, "i", "j"])
    return found.groupBy(*over).agg(F.avg("ari").alias("mean_ari"), F.stddev_samp("ari").alias("sd_ari"), F.count(F.lit(1)).alias("pairs"))
