"""Hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import names, pixels, vectors
from tilewright.operators import cluster, compare, graph, models, samples, smooth, tiles
from tilewright.operators import tree as trees
from tilewright.plans import fixtures as fx
from tilewright.sources import readers, writers
from tilewright.streaming import scoring


def histogram(spark, words, **kw):
    return pixels.word_histograms(spark.createDataFrame([(1, w) for w in words], "id int, word int"), "id", **kw).first().histogram


def test_word_histogram(spark):
    found = histogram(spark, [3] * 5 + [7] * 5 + [10], compat=True)
    assert {k: n for k, n in enumerate(found) if n} == {0: 5, 145: 5, 254: 1} and len(found) == 255
    assert histogram(spark, [4] * 3, compat=True)[127] == 3
    whole = histogram(spark, range(256), compat=True)
    assert whole[-1] == 2 and set(whole[:-1]) == {1}
    edges = histogram(spark, [0, 11, 22, 33], compat=True)
    assert [k for k, n in enumerate(edges) if n] == [0, 84, 169, 254]
    fixed = histogram(spark, [0, 255, 255])
    assert len(fixed) == 256 and (fixed[0], fixed[255], sum(fixed)) == (1, 2, 3)


def test_word_histogram_of_words_beyond_the_bins(spark):
    found = histogram(spark, [0, 255, 256, 300, -1, None, 255])
    assert len(found) == 256 and (found[0], found[255], sum(found)) == (1, 2, 3)
    assert histogram(spark, [None, 300]) == [0] * 256
    assert histogram(spark, [5, None, 300], compat=True) == [1, *[0] * 253, 1]


def test_word_histograms_hold_few_rows(spark):
    """No stage holds a row a word and key: words are counted sixteen a row, and no bin is a row of its own."""
    words = spark.range(40 * 512).selectExpr("id div 512 as image", "cast(id % 256 as int) as word")
    for compat in (False, True):
        made = pixels.word_histograms(words, "image", compat=compat)
        assert {tuple(r.histogram) for r in made.collect()} == {(2,) * 254 + (4,) if compat else (2,) * 256}
        text = made._jdf.queryExecution().executedPlan()
        held, left = [], [text]
        while left:
            node = left.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                left.append(node.executedPlan())
                continue
            if node.nodeName().endswith("QueryStage"):
                left.append(node.plan())
            if node.nodeName() == "Exchange":
                held.append(node.metrics().apply("shuffleRecordsWritten").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
        assert held and max(held) <= 40 * 16 * 4


def test_word_histogram_as_numpy(spark):
    random = np.random.default_rng(3)
    for _ in range(3):
        words = random.integers(random.integers(0, 200), 256, 80).tolist()
        assert histogram(spark, words, compat=True) == np.histogram(words, bins=255)[0].tolist()


def test_stain_filter(spark):
    low = -0.3359375
    rows = [(1, [low] * 11), (2, [low] * 10), (3, [-0.3360] * 20), (4, [1.0] * 11), (5, [1.2] * 20), (6, [])]
    got = spark.createDataFrame(rows, "id int, v array<double>").select("id", pixels.stained(F.col("v")).alias("p")).collect()
    assert {r.id for r in got if r.p} == {1, 4}


def test_names(spark):
    rows = spark.createDataFrame([("file:/x%23y/A.PDL1.mrxs%2312-level16-3-44.jpg",), ("A#b.jpg",), ("A_7_8.png",), (None,)], "path string")
    got = rows.select(names.parsed(F.col("path")).alias("t"), names.level_xy(F.col("path")).alias("xy")).collect()
    assert tuple(got[0].t) == ("A.PDL1.mrxs", 12, 16, 3, 44) and got[1].t is None and got[3].t is None
    assert tuple(got[2].xy) == (7, 8) and got[0].xy is None


def grid(spark, codes, choices=None):
    """A 3 x 3 slide of the codes (0 for no tile), whose centre has the given (c2, c3)."""
    rows = []
    for k, code in enumerate(codes):
        if code:
            c2, c3 = choices if choices and k == 4 else (90, 91)
            rows.append(("s", k, k // 3, k % 3, 0 if code == 1 else 1, 0 if code == 1 else code - 2, c2, c3))
    t = spark.createDataFrame(rows, "slide string, n int, x int, y int, positive int, c1 int, c2 int, c3 int")
    cells = tiles.tile_grid(spark.createDataFrame([("s", 3, 3)], "slide string, nx int, ny int"))
    return {r.n: r.c1 for r in smooth.smoothed(t, cells).collect()}


def test_smoothing(spark):
    five, tie = [5, 5, 5, 5, 9, 5, 6, 6, 6], [5, 5, 5, 5, 9, 6, 6, 6, 6]
    assert grid(spark, five, (3, 4))[4] == 3
    assert grid(spark, five, (4, 3))[4] == 3
    assert grid(spark, five, (1, 2))[4] == 7  # not a choice of the tile's
    assert grid(spark, tie, (3, 4))[4] == 7  # no code has five cells
    assert grid(spark, [1] * 4 + [9] + [1] * 4, (3, 4))[4] == -1
    assert grid(spark, [0] * 4 + [9] + [0] * 4, (3, 4))[4] == -2
    assert grid(spark, [1] * 4 + [9] + [1, 1, 5, 6], (3, 4))[4] == 7  # six aren't clear
    assert grid(spark, [5] * 4 + [9] + [9] + [5] * 3, (3, 4))[4] == 7  # a neighbour is alike
    assert grid(spark, five, (3, 4))[0] == 3  # edges stay


def test_labelled_preference(spark):
    rows = [(1, 5, 1, 6, 0.0, 0.5, 0.9), (2, 5, 6, 1, 0.0, 0.5, 0.9), (3, 5, 1, 2, 0.0, 1.5, 1.6), (4, 0, 1, 2, 0.0, 0.1, 0.2), (5, 5, 6, 1, 0.0, 1.0, 1.5)]
    t = spark.createDataFrame(rows, "id int, c1 int, c2 int, c3 int, d1 double, d2 double, d3 double")
    got = {r.id: (r.c1, r.c2, r.c3) for r in cluster.labelled_preference(t, 3).collect()}
    assert got == {1: (1, 5, 6), 2: (1, 6, 5), 3: (5, 1, 2), 4: (0, 1, 2), 5: (5, 6, 1)}
    old = {r.id: (r.c1, r.c2, r.c3) for r in cluster.labelled_preference(t, 3, compat=True).collect()}
    assert old[1] == (1, 5, 6) and old[2] == (5, 6, 1)


def test_comparison_edges(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (2, 2)], "a int, b int")
    found = {(r.a, r.b): (r.n, r.of_union, r.of_a) for r in compare.overlap(pairs).collect()}
    assert found[0, 0] == (2, 100.0, 100.0) and found[1, 1] == (0, None, None) and len(found) == 9
    assert compare.rand_index(pairs).first().ari == 1.0
    assert compare.overlap(pairs.limit(0)).count() == 0
    sizes = {r.cluster: r.n for r in compare.cluster_sizes(spark.createDataFrame([(0,), (2,), (-2,)], "c1 int")).collect()}
    assert sizes == {0: 1, 1: 0, 2: 1}


def brute_forest(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.add((a, b, w))
    return out, {x: min(y for y in list(up) if root(y) == root(x)) for x in list(up)}


def test_forest_and_components(spark):
    random = np.random.default_rng(5)
    edges = [(min(a, b), max(a, b), float(w)) for a, b, w in zip(*random.integers(0, 60, (2, 70)).tolist(), random.integers(1, 9, 70).tolist(), strict=True) if a != b]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    forest, roots = brute_forest(edges)
    for one_task in (graph.ONE_TASK, 0):
        assert {tuple(r) for r in graph.spanning_forest(df, one_task).collect()} == forest
        assert {r.node: r.root for r in graph.components(df, one_task).collect()} == roots


def test_concept_tree(spark):
    segments = spark.createDataFrame([(i, f"s{i % 2}", [float(i), 1.0]) for i in range(6)], "id bigint, slide string, features array<double>")
    forest = spark.createDataFrame([(0, 1, 1.0), (2, 3, 2.0), (1, 2, 3.0), (4, 5, 1.0)], "a bigint, b bigint, w double")
    got = {r.node: r for r in trees.concept_tree(forest, segments).collect()}
    assert len(got) == 6 + 4 and got[6].population == 2 and got[6].descriptor == [0.5, 1.0] and got[6].slides == ["s0", "s1"]
    assert got[8].population == 4 and got[8].parent is None and got[8].descriptor == [1.5, 1.0] and {got[8].left, got[8].right} == {6, 7}
    assert got[10].population == 2 and got[0].parent == 6 and got[0].left is None
    reduced = trees.significant_tree(trees.concept_tree(forest, segments)).collect()
    assert {(r.node, r.left, r.right) for r in reduced if r.tree == 0 and r.left is not None} >= {(8, 6, 7)}


def test_similarity_of_a_tree_with_itself(spark):
    t = fx.tree(spark)
    by = {r.node: r for r in t.collect()}

    def score(a, b):
        if by[a].left is None or by[b].left is None:
            return float(np.dot(by[a].descriptor, by[b].descriptor))
        d = lambda x, y: float(np.dot(by[x].descriptor, by[y].descriptor))
        l, r, p, q = by[a].left, by[a].right, by[b].left, by[b].right
        if d(l, p) + d(r, q) < d(l, q) + d(r, p):
            p, q = q, p
        return (score(l, p) + score(r, q)) / 2

    assert trees.similarity(t, t, 14, 14).first().score == pytest.approx(score(14, 14))


def test_segmentation():
    a, b, w = np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4]), np.array([1.0, 1.0, 50.0, 1.0])
    assert graph.segment(a, b, w, 10.0) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert graph.segment(a, b, w + 100, 10.0) == {}


def test_knn_in_blocks(spark):
    random = np.random.default_rng(2)
    points = random.normal(size=(37, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, features array<double>")
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(min(i, j), max(i, j)) for i in range(37) for j in np.argsort(d[i])[:4].tolist()}
    assert {(r.a, r.b) for r in graph.knn_edges(df, cell=10).collect()} == want


def test_spacing(spark):
    t = spark.createDataFrame([("s", x) for x in (0, 100, 40, 95)] + [("one", 3)], "slide string, x int")
    assert {r.slide: r.delta for r in graph.grid_spacing(t).collect()} == {"s": 5, "one": None}


def test_systematic_sample_and_draws(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    assert sorted(r.id for r in tiles.systematic_sample(rows, ["id"]).collect()) == list(range(0, 1000, 50))
    drawn = samples.with_replacement(rows.where("id < 40"), "g", ["id"], 32)
    assert drawn.count() == 14 + 13 + 13
    assert {(r.g, r["count"]) for r in samples.with_replacement(rows, "g", ["id"], 32).groupBy("g").count().collect()} == {(0, 32), (1, 32), (2, 32)}


def test_models(spark, sf_dir):
    rows = fx.patches(spark, sf_dir).where("positive = 1").drop("label")
    small = models.reduced(rows, 0.5)
    first = np.array([r.reduced for r in small.select("reduced").collect()])
    assert np.allclose(first.mean(0), 0, atol=1e-8) and np.allclose(first.std(0), 1, atol=1e-8) and first.shape[1] < 64
    found, centres = models.clustered(rows, 4)
    again = cluster.nearest(rows, centres, 1).select("slide", "n", "c1").join(found.select("slide", "n", "label"), ["slide", "n"])
    assert again.where("c1 <> label").count() == 0
    vectors_ = np.array([r.features for r in rows.select("features").collect()])
    values, axes = np.linalg.eigh(np.cov(vectors_.T, bias=True))
    model = sorted(models.fit_reduction(rows, components=50).collect())
    assert len(model) == 50 and np.allclose([m.scale**2 for m in model], values[::-1][:50]) and all(abs(abs(np.dot(m.weights, axes[:, -1 - i])) - 1) < 1e-6 for i, m in enumerate(model[:5]))
    inertia = lambda c: sum(r.d1**2 for r in cluster.nearest(rows, c, 1).select("d1").collect())
    assert inertia(centres) < inertia(centres.where("id < 2"))
    runs = models.runs(rows, ["slide", "n"], [2, 3], 2)
    assert {r.k: r.pairs for r in compare.stability(runs, ["slide", "n"], ["k"]).collect()} == {2: 1, 3: 1}


def test_visual_words(spark):
    random = np.random.default_rng(0)
    images = spark.createDataFrame([(i, 12, 12, random.integers(0, 255, 144).tolist()) for i in range(4)], "id int, height int, width int, pixels array<int>")
    words = models.visual_words(images, 4, every=1)
    got = models.word_counts(images, words).collect()
    assert len(got) == 4 and all(sum(r.histogram) == 25 and len(r.histogram) == 4 for r in got)


def test_vectors(spark):
    r = spark.sql("select array(3D, 4D) as a, array(0D, 0D) as z, array(1D, 2D, 3D) as p").select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("z")), vectors.softmax(F.col("p"))).first()
    assert r[0] == 5 and r[1] == pytest.approx(1) and r[2] is None and sum(r[3]) == pytest.approx(1) and r[3][2] == pytest.approx(np.exp(3) / np.exp([1, 2, 3]).sum())


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0, 1, 2, [1.0, 2.0]), ("B", 0, 3, 4, [3.0, 4.0])], "Slidename string, n int, XPosition int, YPosition int, features array<double>").drop("n")
    writers.write_csv(writers.spread_features(rows, 2, "xception_feature"), str(tmp_path / "d.csv"))
    back = readers.described(spark, str(tmp_path / "d.csv"))
    assert {(r.Slidename, r.architecture, tuple(r.features)) for r in back.collect()} == {("A", "xception", (1.0, 2.0)), ("B", "xception", (3.0, 4.0))}
    writers.write_csv(rows.limit(0).drop("features"), str(tmp_path / "d.csv"))  # what exists stays
    assert readers.described(spark, str(tmp_path / "d.csv")).count() == 2
    assert readers.feature_columns(["x", "my_net_feature_10", "my_net_feature_2"]) == ("my_net", ["my_net_feature_2", "my_net_feature_10"])
    for n in ("a.PDL1.mrxs", ".b.PDL1.mrxs", "c.txt"):
        (tmp_path / "slides").mkdir(exist_ok=True)
        (tmp_path / "slides" / n).write_text("x")
    assert [r.slide for r in readers.slides(spark, str(tmp_path / "slides")).collect()] == ["a.PDL1.mrxs"]
    tiles_dir = tmp_path / "tiles"
    tiles_dir.mkdir()
    (tiles_dir / "S#3-level16-1-2.jpg").write_bytes(b"x")
    assert tuple(readers.tile_images(spark, str(tiles_dir)).select("slide", "n", "level", "x", "y").first()) == ("S", 3, 16, 1, 2)
    (tmp_path / "c.csv").write_text("0,0.1,0.2,0.3\n")
    assert readers.table(spark, str(tmp_path / "c.csv"), readers.COLOURS).first().g == 0.2


def test_stream(spark, sf_dir, tmp_path):
    rows, centres = fx.patches(spark, sf_dir).where("positive = 1"), fx.centroids(spark, sf_dir)
    rows.where("n < 50").write.parquet(str(tmp_path / "in"))
    rows.where("n >= 50").write.mode("append").parquet(str(tmp_path / "in"))
    scoring.score(scoring.arriving(spark, str(tmp_path / "in"), rows.schema, 1), centres, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), cluster.nearest(rows, centres)
    assert got.count() == want.count() and got.select("slide", "n", "c1").exceptAll(want.select("slide", "n", "c1")).isEmpty()


def test_singletons_are_segments_where_asked(spark):
    """Tiles 0 and 1 are joined, 2 has an edge too heavy, 3 none."""
    edges = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 2, 99.0)], "slide string, a bigint, b bigint, w double")
    tiles = spark.createDataFrame([("s", n) for n in range(4)], "slide string, n bigint")
    assert {(r.n, r.label) for r in graph.felzenszwalb(edges).collect()} == {(0, 0), (1, 0)}
    assert {(r.n, r.label) for r in graph.felzenszwalb(edges, keep_singletons=True).collect()} == {(0, 0), (1, 0), (2, 1)}
    assert {(r.n, r.label) for r in graph.felzenszwalb(edges, keep_singletons=True, tiles=tiles).collect()} == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_visual_words_from_all_windows(spark, monkeypatch):
    """Two images of 23 x 23 pixels have 256 windows each."""
    seen, fit = [], models.clustered
    monkeypatch.setattr(models, "clustered", lambda rows, *given: seen.append(rows.count()) or fit(rows, *given))
    images = spark.createDataFrame([(i, 23, 23, [(i * 90 + k * k) % 256 for k in range(529)]) for i in range(2)], "id int, height int, width int, pixels array<int>")
    assert models.visual_words(images, 2, every=1).count() == 2 and seen == [512]


def test_saved_models(spark, sf_dir, tmp_path):
    """A reduction and centroids that were written score other rows as the ones they came from."""
    rows = fx.patches(spark, sf_dir).where("positive = 1").drop("label")
    model, (_, centres) = models.fit_reduction(rows, 0.5), models.clustered(rows, 3)
    writers.write_table(model, str(tmp_path / "pca"))
    writers.write_table(centres, str(tmp_path / "centres"))
    own = lambda df: {(r.slide, r.n): r[2] for r in df.collect()}
    assert own(models.apply_reduction(rows, spark.read.parquet(str(tmp_path / "pca"))).select("slide", "n", "reduced")) == own(models.apply_reduction(rows, model).select("slide", "n", "reduced"))
    few = rows.where("n < 10")
    assert own(cluster.nearest(few, spark.read.parquet(str(tmp_path / "centres")), 1).select("slide", "n", "c1")) == own(cluster.nearest(few, centres, 1).select("slide", "n", "c1"))


def test_consensus_clustering(spark):
    """Two clouds: every run that may, splits them; two is the best number, and prediction gives them back."""
    from tilewright.operators import consensus

    random = np.random.default_rng(0)
    points = [(i, (random.normal(size=2) * 0.01 + (i % 2) * 5).tolist()) for i in range(24)]
    rows = spark.createDataFrame(points, "id bigint, features array<double>")
    runs, matrix, changes = consensus.fit(rows, "id", [2, 3], 2, 0.8, models.kmeans)
    assert runs.groupBy("k", "run").count().where("count <> 19").isEmpty()
    found = {(r.i, r.j): r.m for r in matrix.where("k = 2").collect()}
    assert set(found.values()) == {1.0} and all(i % 2 == j % 2 for i, j in found)
    assert [r.k for r in changes.collect()] == [2]
    for got in (consensus.predict(matrix, rows.select("id"), 2, models.kmeans), consensus.predict_data(rows, "id", changes, models.kmeans)):
        labels = {r.id: r.label for r in got.collect()}
        assert len(labels) == 24 and len({labels[i] for i in range(0, 24, 2)}) == 1 and labels[0] != labels[1]
    three = spark.createDataFrame([(0, r, i, i // 2) for r in range(2) for i in range(6)], "k int, run int, id bigint, label int")
    assert {r.id: r.label for r in consensus.ensemble(three, 0.5, most=2).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2}


def test_extension_points(spark):
    images = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "id int, pixels array<double>")
    got = models.features(images, "encoder", encoder=lambda: lambda batch: np.stack([batch.sum(1), batch.max(1)], 1), shape=[3])
    assert {r.id: r.features for r in got.collect()} == {1: [6.0, 3.0], 2: [15.0, 6.0]}
    with pytest.raises(ValueError):
        models.features(images, "other")


def test_typed_readers(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    red, blue = b"\xff\x00\x00", b"\x00\x00\xff"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + red + blue)) + chunk(b"IEND", b"")
    (tmp_path / "images" / "a").mkdir(parents=True)
    (tmp_path / "images" / "a" / "s_3_4.png").write_bytes(png)
    (tmp_path / "images" / "a" / "note.txt").write_text("x")
    got = readers.pixels(spark, str(tmp_path / "images" / "a")).first()
    assert (got.height, got.width, got.channels, got.pixels) == (1, 2, 3, [255, 0, 0, 0, 0, 255])
    assert tuple(readers.level_images(spark, str(tmp_path / "images" / "a")).select("x", "y").first()) == (3, 4)
    found = readers.classes(spark, str(tmp_path / "images"))
    assert found.select("class").first()[0] == "a" and readers.largest_class(found).first().most == 1
    with pytest.raises(ValueError):
        samples.check_classes(found)
    labels = spark.createDataFrame([("s", 0, 5)], "slide string, n int, label int")
    tiles_ = spark.createDataFrame([("s", 0, 1, 2, [0.5, 1.5]), ("s", 1, 1, 3, [0.0, 0.0])], "slide string, n int, x int, y int, features array<double>")
    writers.write_csv(writers.segmentation_table(tiles_, labels, 2, "net").drop("slide"), str(tmp_path / "seg.csv"))
    assert [tuple(r) for r in readers.segmentation(spark, str(tmp_path / "seg.csv")).collect()] == [(5, 1, 2)]
    stack = spark.createDataFrame([("s", 5, 0, 0.5, 1.5)], "Slidename string, InSlideId int, GlobalId int, net_feature_0 double, net_feature_1 double")
    writers.write_csv(stack, str(tmp_path / "stack.csv"))
    assert tuple(readers.segments(spark, str(tmp_path / "stack.csv")).first()) == ("s", 5, 0, "net", [0.5, 1.5])
    assert spark.range(1).select(samples.one_hot(F.lit(1), 3).alias("h")).first().h == [0, 1, 0]
    assert spark.range(1).select(vectors.weighted_mean(F.array(F.lit(1.0)), F.lit(1), F.array(F.lit(4.0)), F.lit(2)).alias("m")).first().m == [3.0]


def _brute_matrix(runs):
    """{(k, i, j): m} of (k, run, id, label), for those that are ever together."""
    seen = {}
    for k, run, i, label in runs:
        seen.setdefault((k, i), {})[run] = label
    out = {}
    for (k, i), a in seen.items():
        for (other, j), b in seen.items():
            both = a.keys() & b.keys()
            together = sum(a[r] is not None and a[r] == b[r] for r in both)
            if k == other and i < j and together:
                out[k, i, j] = together / len(both)
    return out


def _odd_runs():
    """Runs that hold some of the ids, few labels, text and null among them."""
    random = np.random.default_rng(6)
    given = [(k, r, i, [None, "a", "b", "c"][random.integers(1 if i % 5 else 0, 4)]) for k in (2, 3) for r in range(3) for i in range(90) if random.random() < 0.7]
    return given + [(2, 0, 200, None), (2, 1, 200, None), (2, 0, 201, None), (3, 0, 300, "alone")]


@pytest.mark.parametrize("side", [7, 2048])
def test_consensus_of_odd_runs(spark, monkeypatch, side):
    """Blocks of any size give the matrix of plain loops, and its pairs aren't shuffled."""
    from tilewright.operators import consensus

    monkeypatch.setattr(consensus, "SIDE", side, raising=False)
    given = _odd_runs()
    df = spark.createDataFrame(given, "k int, run int, id bigint, label string").repartition(3)
    made = consensus.consensus_matrix(df)
    rows = made.collect()
    assert {(r.k, r.i, r.j): r.m for r in rows} == _brute_matrix(given) and len(rows) == len(_brute_matrix(given))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_consensus_matrix_rounds_once_for_two_items(spark, sf_dir):
    """Rounding takes longer than spelling a pair out, so it isn't done for each pair."""
    from tilewright.operators import consensus
    from tilewright.plans import catalog

    given = _odd_runs()
    df = spark.createDataFrame(given, "k int, run int, id bigint, label string")
    assert {(r.k, r.i, r.j): r.m for r in consensus.consensus_matrix(df, 3).collect()} == {x: round(m, 3) for x, m in _brute_matrix(given).items()}
    plan = catalog.consensus_matrix(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[: plan.index("Generate explode(a#")]


def test_consensus_blocks_get_wider_beyond_a_number(spark, monkeypatch):
    """A block is copied to all others: were they ever more, copies would grow with the square of the ids."""
    from tilewright.operators import consensus

    for name, value in (("SIDE", 2), ("BLOCKS", 3), ("WIDEST", 60)):
        monkeypatch.setattr(consensus, name, value, raising=False)
    asked, pairs = [], consensus._block_pairs
    monkeypatch.setattr(consensus, "_block_pairs", lambda items, n: asked.append(n) or pairs(items, n))
    given = _odd_runs()
    df = spark.createDataFrame(given, "k int, run int, id bigint, label string").repartition(3)
    assert {(r.k, r.i, r.j): r.m for r in consensus.consensus_matrix(df).collect()} == _brute_matrix(given) and asked == [3]
    consensus.consensus_shares(df).collect()
    assert asked[1] <= 3
    assert [consensus._many(n) for n in (0, 1, 5, 180, 181)] == [1, 1, 3, 3, 4]


def test_consensus_matrix_takes_little_disk(spark, tmp_path):
    """Pairs come in an order that Parquet encodes well, so that the written matrix isn't a byte or more a pair."""
    from tilewright.operators import consensus

    runs = spark.range(3000).selectExpr("2 as k", "explode(sequence(0, 2)) as run", "id").selectExpr("k", "run", "id", "pmod(xxhash64(id, if(pmod(xxhash64(id, run, 1), 7) = 0, run, 9)), 8) as label")
    consensus.consensus_matrix(runs, 6).write.parquet(str(tmp_path / "m"))
    made = spark.read.parquet(str(tmp_path / "m"))
    got = made.count()
    assert got > 500_000 and made.where("i < j").select("i", "j").distinct().count() == got
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")) < 0.6 * got


@pytest.mark.parametrize(("run", "batch"), [(16, 40), (8, 1), (512, 1 << 19)])
def test_consensus_runs_spell_each_pair_once(monkeypatch, run, batch):
    import pyarrow as pa

    from tilewright.operators import consensus

    monkeypatch.setattr(consensus, "RUN", run)
    monkeypatch.setattr(consensus, "BATCH", batch)
    random = np.random.default_rng(4)
    left, right = ([[f"{c}{i}.{n}" for n in range(random.integers(1, 45))] for i in range(9)] for c in "ab")
    p, q = np.nonzero(random.random((9, 9)) < 0.6)
    m = random.integers(1, 4, len(p)) / 3
    parts = list(consensus._runs(pa.array(left), pa.array(right), p, q, m))
    got = [(a, b, v) for some in parts for x, y, v in zip(some[0].to_pylist(), some[1].to_pylist(), some[2].tolist(), strict=True) for a in x for b in y]
    assert sorted(got) == sorted((a, b, v) for i, j, v in zip(p, q, m.tolist(), strict=True) for a in left[i] for b in right[j])
    assert all(0 < len(y) <= run and (len(y) < 8 or len(y) % 8 == 0) for some in parts for y in some[1].to_pylist())
    assert len(parts) == 2 if batch > 1 << 18 else len(parts) > 5
    none = np.zeros(0, np.int64)
    assert not list(consensus._runs(pa.array(left), pa.array(right), none, none, none / 1.0))


@pytest.mark.parametrize("side", [7, 2048])
def test_consensus_shares_of_odd_runs(spark, monkeypatch, side):
    from collections import Counter

    from tilewright.operators import consensus

    monkeypatch.setattr(consensus, "SIDE", side, raising=False)
    given = _odd_runs()
    df = spark.createDataFrame(given, "k int, run int, id bigint, label string").repartition(3)
    want = _brute_matrix(given)
    shares = consensus.consensus_shares(df)
    assert {(r.k, r.m): r.pairs for r in shares.collect()} == Counter((k, m) for (k, _, _), m in want.items())
    matrix = spark.createDataFrame([(*x, m) for x, m in want.items()], "k int, i bigint, j bigint, m double")
    area = lambda m: {r.k: round(r.area, 9) for r in consensus.consensus_area(m, 93).collect()}
    assert area(shares) == area(matrix)


def test_consensus_area_does_not_spell_pairs_out(spark, sf_dir, monkeypatch):
    from tilewright.operators import consensus
    from tilewright.plans import catalog

    monkeypatch.delattr(consensus, "consensus_matrix")
    assert catalog.consensus_area(spark, sf_dir).count() == 2


@pytest.mark.parametrize("side", [7, 2048])
@pytest.mark.parametrize("at_least", [0.3, 0.7, 1.0])
def test_consensus_ensemble_of_odd_runs(spark, monkeypatch, side, at_least):
    """Clusters of plain loops; links of ids with the same labels, or within what is already joined, don't go on."""
    from tilewright.operators import consensus, graph

    monkeypatch.setattr(consensus, "SIDE", side, raising=False)
    sent, components = [], graph.components

    def counted(edges):
        sent.append(edges.count())
        return components(edges)

    monkeypatch.setattr(graph, "components", counted)
    given = [(0, 10 * k + r, i, x) for k, r, i, x in _odd_runs()] + [(0, r, i, "many") for r in range(40, 43) for i in range(1000, 1200)]
    tree = {i: i for _, _, i, _ in given}
    for (_, i, j), m in _brute_matrix(given).items():
        if m >= at_least:
            a, b = sorted((tree[i], tree[j]))
            tree = {x: a if root == b else root for x, root in tree.items()}
    got = consensus.ensemble(spark.createDataFrame([g[1:] for g in given], "run int, id bigint, label string").repartition(3), at_least)
    assert {r.id: r.label for r in got.collect()} == tree
    assert sent[0] < 19_900


@pytest.mark.parametrize("block", [4, 8192])
def test_nearest_of_many(spark, monkeypatch, block):
    """The same bits as nearest(), with copies among the centroids, blocks of any size and a null vector."""
    from tilewright.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", block)
    random = np.random.default_rng(8)
    vectors = random.normal(0, 40, (30, 6)).tolist() + [[1.0] * 6] * 5
    centres = spark.createDataFrame([(7 * i, v) for i, v in enumerate(vectors[::2] + [[1.0] * 6] * 9)], "id int, features array<double>").repartition(3)
    rows = spark.createDataFrame(list(enumerate(vectors)), "n int, features array<double>").repartition(2)
    columns = ["n", "c1", "c2", "c3", "d1", "d2", "d3"]
    own = lambda df: sorted(map(tuple, df.select(columns).collect()))
    got = cluster.nearest_of_many(rows, centres)
    assert own(got) == own(cluster.nearest(rows, centres)) and dict(got.dtypes)["c1"] == "int"
    none = spark.createDataFrame([(1, None)], "n int, features array<double>")
    assert own(cluster.nearest_of_many(none, centres)) == [(1, *[None] * 6)]
    assert own(cluster.nearest_of_many(rows, centres.limit(2), 3)) == own(cluster.nearest(rows, centres.limit(2)))


def test_seeds_are_not_compared_in_lambdas(spark, sf_dir):
    """Seeds grow with the rows: a vector an array of distances to all of them took most of the time."""
    from tilewright.plans import catalog

    assert "zip_with" not in catalog.semi_supervised_clusters(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
