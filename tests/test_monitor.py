"""The monitor's stream against the distances of all its rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import samples
from tilewright.streaming import monitor, scoring

ROWS = "id bigint, label string, features array<double>"


def rows(n, seed=2):
    rng = np.random.default_rng(seed)
    return [(i, "abc"[i % 3], (rng.normal(size=4) + (i % 3)).tolist()) for i in range(n)]


def of_all(df):
    intra = {(r.label, r.label): r.intra for r in samples.intra_class(df).collect()}
    return intra | {(min(r.a, r.b), max(r.a, r.b)): r.inter for r in samples.inter_class(df).collect()}


def seen(df):
    return {(r.a, r.b): r.distance for r in df.collect()}


def test_stream_equals_all_rows_also_after_a_restart(spark, tmp_path):
    own, top = rows(60), str(tmp_path)
    done = []
    for first in (0, 5):
        for b in range(first, first + 5):
            spark.createDataFrame(own[b * 6 : b * 6 + 6], ROWS).coalesce(1).write.mode("append").parquet(f"{top}/in")
            done += own[b * 6 : b * 6 + 6]
        stream = scoring.arriving(spark, f"{top}/in", ROWS, files=1)
        query = monitor.watch(stream, f"{top}/out", f"{top}/checkpoint", every=3)
        query.awaitTermination(120)
        assert query.exception() is None
    history = monitor.history(spark, f"{top}/out")
    assert sorted(r.batch for r in history.select("batch").distinct().collect()) == [0, 3, 6, 9]
    for batch in (0, 3, 6, 9):
        assert seen(history.where(F.col("batch") == batch)) == pytest.approx(of_all(spark.createDataFrame(done[: 6 * (batch + 1)], ROWS)))


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    own, path = rows(30), str(tmp_path)
    for version in (0, 1, 1, 2, 2):
        monitor.update(path, spark.createDataFrame(own[version * 10 : version * 10 + 10], ROWS), version, every=2)
    assert seen(monitor.history(spark, path).where("batch = 2")) == pytest.approx(of_all(spark.createDataFrame(own, ROWS)))


def test_odd_rows(spark):
    own = spark.createDataFrame([*rows(9), (20, None, [1.0, 2.0, 3.0, 4.0]), (21, "a", None), (22, "b", [0.0] * 4), (23, "z", [0.0] * 4)], ROWS).withColumn("n", F.lit("x")).withColumn("total", F.lit(1))
    found = seen(monitor.cosines(monitor.over([own.where("id < 5"), own.where("id >= 5"), own.where("false")])))
    assert found == pytest.approx(of_all(spark.createDataFrame(rows(9), ROWS)))
