"""Concept trees, intervals and paths against plain versions, whatever the blocks, and at depth."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import dendrogram
from tilewright.operators import tree as trees

FOREST, SEGMENTS = "a bigint, b bigint, w double", "id bigint, slide string, features array<double>"


def plain_trees(forest, segments):
    """{node: (tree, parent, left, right, weight, population, descriptor, slides)} by merging in order."""
    up = {i: i for e in forest for i in e[:2]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    least = dict(up)
    for a, b, _ in forest:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    least = {x: find(x) for x in up}
    ids = {t: sorted(x for x in up if least[x] == t) for t in set(least.values())}
    more = max(s[0] for s in segments) + 1
    vec, slide = {s[0]: np.array(s[2], float) for s in segments}, {s[0]: {s[1]} for s in segments}
    node = {x: [least[x], None, None, None, None, 1, vec[x], slide[x]] for x in up}
    top, nth = {x: x for x in up}, dict.fromkeys(ids, 0)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for w, a, b in sorted((w, a, b) for a, b, w in forest):
        t = least[a]
        new = ids[t][nth[t]] + more
        nth[t] += 1
        p, q = root(a), root(b)
        n = node[p][5] + node[q][5]
        node[new] = [t, None, p, q, w, n, (node[p][5] * node[p][6] + node[q][5] * node[q][6]) / n, node[p][7] | node[q][7]]
        node[p][1] = node[q][1] = top[p] = top[q] = top[new] = new
    return node


def checked(spark, forest, segments, block):
    df = trees.concept_tree(spark.createDataFrame(forest, FOREST).repartition(3), spark.createDataFrame(segments, SEGMENTS).repartition(3), block)
    got = {r.node: r for r in df.collect()}
    want = plain_trees(forest, segments)
    assert sorted(got) == sorted(want)
    for n, (t, parent, left, right, w, pop, vec, slides) in want.items():
        r = got[n]
        assert (r.tree, r.parent, r.left, r.right, r.weight, r.population, set(r.slides)) == (t, parent, left, right, w, pop, slides), n
        assert np.allclose(r.descriptor, vec, atol=1e-9) and r.slides == sorted(r.slides)
        if left is not None:
            big, small = sorted((left, right), key=lambda c: (want[c][5], c), reverse=True)
            assert (got[big].enter, got[small].enter) == (r.enter, r.enter + want[big][5])
    assert sorted(r.enter for r in got.values() if r.left is None) == list(range(sum(v[2] is None for v in want.values())))
    return df, want


def random_forest(rng, n, parts, weights):
    """A random forest over n segments with gaps in their ids; few weights make ties."""
    ids = np.sort(rng.choice(n * 3, n, replace=False)).tolist()
    edges, seen = [], {}
    for i in rng.permutation(n).tolist():
        p = i % parts
        if p in seen:
            j = seen[p][int(rng.integers(len(seen[p])))]
            a, b = sorted((ids[i], ids[j]))
            edges.append((a, b, float(rng.integers(weights))))
        seen.setdefault(p, []).append(i)
    return edges, [(i, f"S{int(rng.integers(5))}", rng.normal(size=3).tolist()) for i in ids]


def plain_significant(want):
    out = set()
    for root in (n for n, v in want.items() if v[1] is None):
        todo = [(root, None)]
        while todo:
            node, parent = todo.pop()
            best, at = None, node
            while want[at][2] is not None:
                small, big = sorted(want[at][2:4], key=lambda c: (want[c][5], c))
                if best is None or want[small][5] >= best[0]:
                    best = (want[small][5], small, big)
                at = big
            pair = best[1:] if best else (None, None)
            out.add((want[node][0], node, parent, *pair, want[node][5]))
            todo += [(c, node) for c in pair if c is not None]
    return out


@pytest.mark.parametrize(("n", "parts", "weights", "block"), [(60, 1, 10**6, 7), (90, 4, 3, 5), (40, 1, 1, 1000), (64, 2, 50, 1)])
def test_trees_in_blocks(spark, monkeypatch, n, parts, weights, block):
    monkeypatch.setattr(dendrogram, "LEAVES", 8)
    monkeypatch.setattr(dendrogram.interval_sums, "__defaults__", (8,))
    rng = np.random.default_rng(n)
    df, want = checked(spark, *random_forest(rng, n, parts, weights), block)
    made = trees.significant_tree(df).collect()
    assert {tuple(r) for r in made} == plain_significant(want) and len(made) == len(plain_significant(want))

    def below(x):
        return {x} if want[x][2] is None else below(want[x][2]) | below(want[x][3])

    under = {(x, leaf) for x in want for leaf in below(x)}
    for table in (df, df.drop("enter")):
        found = trees.leaves_under(table, table.select("node")).collect()
        assert {tuple(r) for r in found} == under and len(found) == len(under)
    assert {tuple(r) for r in trees.significant_tree(df.drop("enter")).collect()} == plain_significant(want)


def test_a_chain_of_merges(spark, monkeypatch):
    """Edges each heavier than the one before, over several blocks: as deep as it is large."""
    monkeypatch.setattr(dendrogram.interval_sums, "__defaults__", (16,))
    n = 70
    edges = [(i, i + 1, float(i)) for i in range(n - 1)]
    df, want = checked(spark, edges, [(i, f"S{i % 3}", [float(i), 1.0]) for i in range(n)], 6)
    assert {tuple(r) for r in trees.significant_tree(df).collect()} == plain_significant(want)


def test_one_hundred_thousand_leaves_in_a_chain(spark):
    n = 100_000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").cast("double").alias("w"))
    segments = spark.range(n).select("id", F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("slide"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    began = time.time()
    df = trees.concept_tree(edges, segments, block=1 << 15).cache()
    told = df.where("left is not null").select(F.count(F.lit(1)), F.max(F.abs(F.element_at("descriptor", 1) - (F.col("population") - 1) / 2)), F.min(F.size("slides")), F.max("population"), F.max("enter")).first()
    assert told[0] == n - 1 and told[1] < 1e-6 and told[2:] == (2, n, 0)
    nodes = df.where("population in (10, 5000, 100000)").select("node")
    assert trees.leaves_under(df, nodes).count() == 105_010
    # Every merge but the first adds one leaf: the first fork of two leaves is the only one.
    assert trees.significant_tree(df).count() == 3
    assert time.time() - began < 300
    df.unpersist()


def test_odd_forests(spark):
    segments = spark.createDataFrame([(5, "A", [1.0]), (9, "B", [3.0]), (11, None, [5.0])], SEGMENTS).withColumn("tree", F.lit("x"))
    assert trees.concept_tree(spark.createDataFrame([], FOREST), segments).collect() == []
    got = trees.concept_tree(spark.createDataFrame([(5, 9, 1.0)], FOREST), segments).orderBy("node").collect()
    assert [(r.node, r.parent, r.population, r.descriptor, r.slides, r.enter) for r in got] == [(5, 17, 1, [1.0], ["A"], 1), (9, 17, 1, [3.0], ["B"], 0), (17, None, 2, [2.0], ["A", "B"], 0)]
    assert [tuple(r) for r in trees.significant_tree(spark.createDataFrame(got)).orderBy("node").collect()] == [(5, 5, 17, None, None, 1), (5, 9, 17, None, None, 1), (5, 17, None, 5, 9, 2)]


def test_similarity_of_deep_trees_ends(spark):
    """Two chains: what is left after some hundred levels is under the rounding."""
    n = 130
    rows, at = [(0, None, None, 1, [1.0])], 0
    for k in range(1, n):
        rows += [(2 * k - 1, None, None, 1, [0.5]), (2 * k, at, 2 * k - 1, k + 1, [1.0 + k / n])]
        at = 2 * k
    t = spark.createDataFrame(rows, "node bigint, left bigint, right bigint, population bigint, descriptor array<double>")
    by = {r[0]: r for r in rows}

    def score(x, y):
        (_, a, b, _, v), (_, c, d, _, w) = by[x], by[y]
        if a is None or c is None:
            return v[0] * w[0]
        p = lambda i, j: by[i][4][0] * by[j][4][0]
        pairs = ((a, c), (b, d)) if p(a, c) + p(b, d) >= p(a, d) + p(b, c) else ((a, d), (b, c))
        return 0.5 * sum(score(i, j) for i, j in pairs)

    assert trees.similarity(t, t, at, at).first().score == pytest.approx(score(at, at), rel=1e-14)


def test_export_plan_asks_only_nodes_with_a_quota(spark, monkeypatch):
    """On a chain the leaves of all inner nodes grow with its square; those of nodes that have a quota don't."""
    from hashlib import md5

    from tilewright.operators import samples

    n, most = 150, 12
    segments = spark.createDataFrame([(i, "s", [float(i)]) for i in range(n)], SEGMENTS)
    tree = trees.concept_tree(spark.createDataFrame([(i, i + 1, float(i)) for i in range(n - 1)], FOREST), segments).cache()
    members = [(i, "s", x, i) for i in range(n) for x in range(1 + i % 9)]
    asked, under = [], trees.leaves_under
    monkeypatch.setattr(trees, "leaves_under", lambda *a: asked.append(under(*a)) or asked[-1])
    df = spark.createDataFrame(members, "global_id bigint, slide string, x int, y int")
    got = sorted(tuple(r) for r in samples.tree_export_plan(tree, df, most).collect())
    places = {i: sorted((md5(f"s-{x}-{i}-7".encode()).hexdigest(), "s", x, i) for x in range(1 + i % 9)) for i in range(n)}
    # The k-th merge, n + k, has the leaves 0 to k + 1.
    want = sorted((n + k, i, *p[1:]) for k in range(n - 1) for i in range(k + 2) for p in places[i][: most // (k + 2)])
    assert got == want
    assert asked[0].count() == sum(range(2, most + 1))
    every = under(tree, tree.where("left is not null").select("node"))
    assert sorted(tuple(r) for r in samples.export_plan(every, df, most).collect()) == want
