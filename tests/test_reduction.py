"""Incremental principal components against one decomposition of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import models, reduction

ROWS = "id bigint, features array<double>"


def data(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * np.linspace(5, 0.5, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + rng.normal(size=d) * 20


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(parts)


def whole(x):
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return s / np.sqrt(len(x)), v


def test_all_components_equal_one_decomposition(spark, monkeypatch):
    monkeypatch.setattr(reduction, "PORTION", 37)
    monkeypatch.setattr(reduction, "FAN", 2)
    x = data(700, 9)
    s, v = whole(x)
    for state in (reduction.fit(table(spark, x, 9), 9), reduction.partial_fit(reduction.partial_fit(None, table(spark, x[:200]), 9), table(spark, x[200:]), 9)):
        assert state.count() == 1 and state.first().n == 700 and state.first().lost < 1e-9
        rows = reduction.model(state).orderBy("component").collect()
        assert np.allclose([r.scale for r in rows], s, atol=1e-6) and np.allclose(np.abs([np.dot(r.weights, v[i]) for i, r in enumerate(rows)]), 1, atol=1e-6)
        assert all(max(r.weights, key=abs) > 0 for r in rows)


def test_few_components_are_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(reduction, "PORTION", 50)
    x = data(900, 30, 3)
    state = reduction.fit(table(spark, x, 6), 8)
    row = state.first()
    axes = np.array(row.axes)
    assert axes.shape == (8, 30) and row.lost > 0
    centred = x - x.mean(0)
    unit = axes / np.sqrt((axes**2).sum(1))[:, None]
    got, best = ((centred @ unit.T) ** 2).sum(), (np.linalg.svd(centred, compute_uv=False)[:8] ** 2).sum()
    assert best - row.lost <= got <= best * (1 + 1e-9) and (axes**2).sum() <= got * (1 + 1e-9)
    reduced = np.array([r.reduced for r in models.apply_reduction(table(spark, x), reduction.model(state, 5)).orderBy("id").collect()])
    assert reduced.shape == (900, 5) and np.allclose(reduced.mean(0), 0, atol=1e-9)
    # A state's own deviation along an axis falls short of the rows' by what was lost, at most.
    s2 = (axes[:5] ** 2).sum(1)
    assert (reduced.var(0) >= 1 - 1e-9).all() and (reduced.var(0) <= 1 + row.lost / s2 + 1e-9).all()


def test_a_saved_state_goes_on(spark, tmp_path):
    x = data(300, 6, 5)
    reduction.fit(table(spark, x[:100]), 6).write.parquet(str(tmp_path / "state"))
    state = reduction.partial_fit(spark.read.parquet(str(tmp_path / "state")), table(spark, x[100:]), 6)
    assert np.allclose([r.scale for r in reduction.model(state).orderBy("component").collect()], whole(x)[0], atol=1e-9)
    both = reduction.together(reduction.fit(table(spark, x[:150]), 6).union(reduction.fit(table(spark, x[150:]), 6)), 6)
    assert np.allclose([r.scale for r in reduction.model(both).orderBy("component").collect()], whole(x)[0], atol=1e-9)


def test_odd_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert reduction.fit(none).count() == 0 and reduction.model(reduction.fit(none)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 4.0])], ROWS).withColumn("n", F.lit("x")).withColumn("mean", F.lit(1))
    state = reduction.fit(rows)
    assert state.first().n == 3
    only = reduction.model(state).collect()
    assert len(only) == 1 and only[0].weights == pytest.approx([0.0, 1.0]) and only[0].shift == pytest.approx(8 / 3)
    same = reduction.partial_fit(state, none)
    assert same.first().n == 3
