"""Mini-batch k-means against a plain loop, and its stream against its tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import minibatch, models
from tilewright.streaming import scoring

ROWS = "id bigint, batch bigint, features array<double>"


def points(n, seed=1, size=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, size)) * 9
    return [(i, i % 7, (middle[i % 4] + rng.normal(size=size)).tolist()) for i in range(n)]


def looped(rows, centres):
    """{batch order} of mini-batch updates in numpy."""
    c, w = np.array(centres, float), np.zeros(len(centres))
    for b in sorted({r[1] for r in rows}):
        x = np.array([r[2] for r in rows if r[1] == b])
        of = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for k in range(len(c)):
            if (of == k).any():
                c[k] = (c[k] * w[k] + x[of == k].sum(0)) / (w[k] + (of == k).sum())
        w += np.bincount(of, minlength=len(c))
    return c, w


def state_of(spark, centres):
    return spark.createDataFrame([(i, list(map(float, c)), 0.0) for i, c in enumerate(centres)], minibatch.STATE)


def held(state):
    rows = sorted((r.id, r.features, r.weight) for r in state.collect())
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_batches_against_a_loop(spark):
    rows = points(500)
    start = [rows[i][2] for i in (0, 1, 2, 3, 4)]
    found = minibatch.fit(spark.createDataFrame(rows, ROWS).repartition(5), state_of(spark, start), "batch")
    c, w = looped(rows, start)
    got, weights = held(found)
    assert np.allclose(got, c) and weights.tolist() == w.tolist()
    labels = {r.id: (r.label, r.d) for r in minibatch.predict(spark.createDataFrame(rows, ROWS), found).collect()}
    d = np.sqrt(((np.array([r[2] for r in rows])[:, None] - c[None]) ** 2).sum(2))
    assert [labels[i][0] for i, _, _ in rows] == d.argmin(1).tolist() and np.allclose([labels[i][1] for i, _, _ in rows], d.min(1))


def test_sums_of_parts_add_up(spark):
    rows = spark.createDataFrame(points(300), ROWS)
    start = state_of(spark, [r[2] for r in points(6)])
    parts = [minibatch.sums(start, rows.where(F.col("id") % 3 == k)) for k in range(3)]
    whole = minibatch.sums(start, rows)
    both = [sorted((r.id, r.n, np.round(r.total, 6).tolist()) for r in x.collect()) for x in (whole, minibatch.added(parts[0].union(parts[1]).union(parts[2])))]
    assert both[0] == both[1]


def test_states_merge_by_weight(spark):
    a = spark.createDataFrame([(0, [0.0, 0.0], 1.0), (1, [1.0, 1.0], 0.0)], minibatch.STATE)
    b = spark.createDataFrame([(0, [4.0, 8.0], 3.0), (1, [3.0, 1.0], 0.0)], minibatch.STATE)
    got, weights = held(minibatch.merged([a, b]))
    assert got.tolist() == [[3.0, 6.0], [2.0, 1.0]] and weights.tolist() == [4.0, 0.0]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 0, [0.0, 0.0]), (2, 0, None), (3, None, [9.0, 9.0]), (None, 0, [2.0, 2.0]), (5, 1, [1.0, 1.0])], ROWS).withColumn("label", F.lit("x")).withColumn("d", F.lit("y"))
    start = state_of(spark, [[0, 0], [2, 2], [50, 50]])
    found = minibatch.fit(rows, start, "batch")
    # The row at [1, 1] is as near to both: it goes to the lower id.
    got, weights = held(found)
    assert np.allclose(got, [[1 / 3, 1 / 3], [2, 2], [50, 50]]) and weights.tolist() == [3.0, 1.0, 0.0]
    made = minibatch.predict(rows, found).collect()
    assert [(r.label, r.d) for r in made if r.id == 2] == [(None, None)] and len(made) == 6
    empty = rows.where("false")
    assert held(minibatch.partial_fit(start, empty))[1].tolist() == [0.0, 0.0, 0.0]
    assert minibatch.initial(empty, 3).collect() == [] and len(minibatch.initial(rows, 10).collect()) == 4


def test_first_centres_dont_depend_on_the_order(spark):
    rows = points(200)
    a, b = (minibatch.initial(spark.createDataFrame(r, ROWS).repartition(n), 6, seed=3).collect() for r, n in ((rows, 2), (rows[::-1], 7)))
    assert [tuple(r) for r in sorted(a)] == [tuple(r) for r in sorted(b)] and len(a) == 6


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of seven files, a batch each, written one after the other."""
    rows = points(350)
    for b in range(7):
        part = spark.createDataFrame([r for r in rows if r[1] == b], ROWS)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path)


def test_a_stream_ends_where_the_batches_do(spark, folder):
    rows, top = folder
    start = [r[2] for r in rows[:4]]
    stream = scoring.arriving(spark, f"{top}/in", ROWS, files=1)
    query = minibatch.fit_stream(stream, state_of(spark, start), f"{top}/state", f"{top}/checkpoint")
    query.awaitTermination(120)
    assert query.exception() is None
    c, w = looped(rows, start)
    got, weights = held(minibatch.latest(spark, f"{top}/state"))
    assert np.allclose(got, c) and weights.tolist() == w.tolist()
    # More files, and a restart from the checkpoint.
    more = [(i, 7, f) for i, _, f in points(60, seed=9)]
    spark.createDataFrame(more, ROWS).coalesce(1).write.mode("append").parquet(f"{top}/in")
    minibatch.fit_stream(scoring.arriving(spark, f"{top}/in", ROWS, files=1), state_of(spark, start), f"{top}/state", f"{top}/checkpoint").awaitTermination(120)
    c, w = looped([*rows, *more], start)
    got, weights = held(minibatch.latest(spark, f"{top}/state"))
    assert np.allclose(got, c) and weights.tolist() == w.tolist()


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    rows = points(90)
    start, path = state_of(spark, [r[2] for r in rows[:3]]), str(tmp_path / "state")
    for version in (0, 1, 1, 2, 2):
        minibatch.update(path, start, spark.createDataFrame([r for r in rows if r[1] % 3 == version], ROWS), version)
    want = minibatch.fit(spark.createDataFrame([(i, b % 3, f) for i, b, f in rows], ROWS), start, "batch")
    got, weights = held(minibatch.latest(spark, path))
    assert np.allclose(got, held(want)[0]) and weights.sum() == 90


def test_scored_stream_counts_each_batch_once(spark, folder):
    """A batch whose commit is lost is run again on restart, and its rows are there once."""
    from pathlib import Path

    rows, top = folder
    centres = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows[:3])], "id int, features array<double>")
    for _ in range(2):
        scoring.score(scoring.arriving(spark, f"{top}/in", ROWS, files=3), centres, f"{top}/out", f"{top}/marks").awaitTermination(120)
        last = max(Path(f"{top}/marks/commits").glob("[0-9]*"), key=lambda f: int(f.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert spark.read.parquet(f"{top}/out").count() == len(rows)


def test_visual_words_in_batches(spark):
    rng = np.random.default_rng(4)
    images = [(i, 9, 9, (rng.integers(0, 2) * 200 + rng.integers(0, 20, 81)).tolist()) for i in range(12)]
    df = spark.createDataFrame(images, "id int, height int, width int, pixels array<int>")
    words = models.visual_words(df, 4, every=1, batches=3)
    assert sorted(r.id for r in words.collect()) == [0, 1, 2, 3]
    counts = models.features(df, "words", words=words).collect()
    assert len(counts) == 12


def test_as_a_clusterer(spark):
    rows = spark.createDataFrame(points(400), ROWS)
    labels = [r.label for r in models.minibatch_kmeans(rows, 4, 7).orderBy("id").collect()]
    assert len(set(labels)) == 4 and all(len({labels[i] for i in range(k, 400, 4)}) == 1 for k in range(4))
