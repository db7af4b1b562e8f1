"""Nearest neighbours by a tree of pivots against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import neighbours

POINTS = "id bigint, features array<double>"


def brute(points, k):
    ids, x = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        for j in np.lexsort((ids, d)):
            if ids[j] != i:
                out.setdefault(i, []).append((int(ids[j]), d[j]))
            if len(out.get(i, ())) == k:
                break
    return {(min(i, j), max(i, j)): d for i, near in out.items() for j, d in near}


@pytest.mark.parametrize(("cell", "fan"), [(1000, 4), (12, 3), (30, 200), (3, 2)])
def test_in_cells(spark, monkeypatch, cell, fan):
    monkeypatch.setattr(neighbours, "PORTION", 17)
    rng = np.random.default_rng(cell)
    middle = rng.normal(size=(6, 3)) * 8
    x = [*(middle[i % 6] + rng.normal(size=3) for i in range(150)), *np.repeat(middle[:3], [2, 4, 9], axis=0), *rng.integers(0, 3, (60, 3))]
    points = [(int(i), np.asarray(v, float).tolist()) for i, v in zip(rng.permutation(1000), x, strict=False)]
    got = neighbours.knn_edges(spark.createDataFrame(points, POINTS).repartition(4), 4, cell, fan).collect()
    want = brute(points, 4)
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want)
    assert all(r.w == pytest.approx(want[r.a, r.b], abs=1e-12) for r in got)


def test_what_a_portion_sends_on_is_bounded(spark, monkeypatch):
    """A portion's kinds times the cells below, to each of which they may go with their vectors."""
    monkeypatch.setattr(neighbours, "ASKED", 2048, raising=False)
    dealt, levels, portions, elsewhere = [], [], neighbours._portions, neighbours._elsewhere

    def kept(*a):
        out = portions(*a)
        dealt.append(out[0])
        return out

    def watched(asked, below, leaves, k):
        levels.extend(below)
        dealt.clear()
        return elsewhere(asked, below, leaves, k)

    monkeypatch.setattr(neighbours, "_portions", kept)
    monkeypatch.setattr(neighbours, "_elsewhere", watched)
    x = np.random.default_rng(5).normal(size=(1500, 8))
    points = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.knn_edges(spark.createDataFrame(points, POINTS), 4, 60, 200)
    assert {(r.a, r.b) for r in got.collect()} == set(brute(points, 4))
    assert levels
    for rows, level in zip(dealt, levels, strict=False):
        fans = level.groupBy(F.col("parent").alias("cell")).agg(F.count(F.lit(1)).alias("fan"))
        most = rows.groupBy("cell", "portion").agg(F.count(F.lit(1)).alias("n")).join(fans, "cell").agg(F.max(F.col("n") * F.col("fan"))).first()[0]
        assert most <= 2 * 2048


def test_odd_points(spark):
    assert neighbours.knn_edges(spark.createDataFrame([], POINTS)).collect() == []
    assert neighbours.knn_edges(spark.createDataFrame([(1, [0.0])], POINTS)).collect() == []
    some = spark.createDataFrame([(1, [0.0]), (2, None), (3, [2.0]), (4, [2.0])], POINTS).withColumn("cell", F.lit("x")).withColumn("copies", F.lit(1))
    assert {tuple(r) for r in neighbours.knn_edges(some).collect()} == {(1, 3, 2.0), (1, 4, 2.0), (3, 4, 0.0)}


def test_one_hundred_thousand_equal_vectors(spark):
    points = spark.range(100_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("features")).union(spark.range(500_000, 500_050).select("id", F.array((F.col("id") - 500_000).cast("double"), F.lit(9.0))))
    edges = neighbours.knn_edges(points, 4)
    told = edges.groupBy((F.col("w") == 0).alias("same")).count().collect()
    counts = {r.same: r["count"] for r in told}
    # Each of the equal ones has the lowest four others.
    assert counts[True] == 10 + 4 * (100_000 - 5)
    few = [(i, [1.0, 2.0]) for i in range(6)] + [(500_000 + i, [float(i), 9.0]) for i in range(50)]
    assert counts[False] == sum(d > 0 for d in brute(few, 4).values())


def test_no_cell_outgrows_its_bound(spark):
    kinds = spark.range(60_000).select("id", F.array(*(F.sin(F.col("id") * (k + 1)) for k in range(3))).alias("features"))
    levels, leaves = neighbours.pivot_tree(kinds, cell=100, fan=16)
    sizes = leaves.groupBy("cell").count().agg(F.max("count"), F.sum("count")).first()
    assert len(levels) > 1 and sizes[0] <= 100 and sizes[1] == 60_000
    assert max(r["count"] for level in levels for r in level.groupBy("parent").count().collect()) < 64


def test_vectors_that_rounding_makes_equal_end(spark):
    kinds = spark.range(50).select("id", F.array(F.col("id") * 1e-200).alias("features"))
    levels, leaves = neighbours.pivot_tree(kinds, cell=10, fan=4)
    assert leaves.count() == 50 and len(levels) == 1
