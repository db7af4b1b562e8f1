"""Graphs over tiles and segments: spacing, neighbours, spanning trees, segmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.vectors import distance, mean_vectors
from tilewright.operators._numbering import numbered
from tilewright.operators._tables import written
from tilewright.operators.neighbours import knn_edges as knn_edges


def grid_spacing(tiles: DataFrame) -> DataFrame:
    """(slide, delta): the least gap between two different x of a slide; null for a slide of one column."""
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("slide").orderBy("x"))
    return tiles.select("slide", "x").distinct().withColumn("gap", gap).groupBy("slide").agg(F.min("gap").alias("delta"))


def neighbour_edges(tiles: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """(slide, a, b, w), a < b: tiles (slide, n, x, y, features) one step apart in x, y or both, and the distance of their vectors. Each tile looks one way only (four of the eight steps), so an edge is found once."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))))
    delta = (grid_spacing(tiles) if spacing is None else spacing).select("slide", F.coalesce("delta", F.lit(1)).alias("delta"))
    looked = tiles.join(delta, "slide").select("slide", F.col("n").alias("p"), F.col("features").alias("f"), "x", "y", "delta", F.explode(steps).alias("s"))
    looked = looked.select("slide", "p", "f", (F.col("x") + F.col("s.i") * F.col("delta")).alias("x"), (F.col("y") + F.col("s.j") * F.col("delta")).alias("y"))
    met = looked.join(tiles.select("slide", "x", "y", F.col("n").alias("q"), F.col("features").alias("g")), ["slide", "x", "y"])
    return met.select("slide", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), distance(F.col("f"), F.col("g")).alias("w"))


class DisjointSets:
    """Union-find with path halving, union by size, and the energy of the last edge taken."""

    def __init__(self, n: int) -> None:
        self.parent, self.size, self.energy = list(range(n)), [1] * n, [0.0] * n

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int, w: float = 0.0) -> int:
        a, b = self.root(a), self.root(b)
        if a != b:
            if self.size[b] > self.size[a]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]
        self.energy[a] = w
        return a


#: Edges that one task takes alone; a larger graph is worked on in rounds of joins, with the same result.
ONE_TASK = 1 << 20


def _kruskal(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of edges (a, b, w), the least node that each is connected to, and whether an edge is of the minimum spanning forest; ties go by (w, a, b)."""
    a, b, w = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["w"].to_numpy(float)
    ids, ends = np.unique(np.stack([a, b]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    sets, taken = DisjointSets(len(ids)), np.zeros(len(a), bool)
    for i in np.lexsort((b, a, w)).tolist():
        p, q = sets.root(int(u[i])), sets.root(int(v[i]))
        if p != q:
            sets.union(p, q)
            taken[i] = True
    roots = np.array([sets.root(k) for k in range(len(ids))], np.int64)
    first = np.unique(roots, return_index=True)
    return ids, ids[first[1]][np.searchsorted(first[0], roots)], taken


def _alone(edges: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return edges.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, schema)


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node reachable. Alternating large and small stars (Kiveris et al. 2014): every node links its larger neighbours, then its smaller ones, to the least around it, until nothing moves; rounds grow with the logarithm of a component."""
    edges = written(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:
        alone = lambda rows: pd.DataFrame(dict(zip(("node", "root"), _kruskal(rows.assign(w=0.0)), strict=False)))
        return written(_alone(edges, alone, "node bigint, root bigint"), "components")
    nodes = written(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "nodes")
    edges = edges.where("a <> b")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "small-star")
        was, state = state, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def spanning_forest(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b, w): the minimum spanning forest of edges (a, b, w), by Boruvka's rounds; ties go by (w, a, b), so it is unique. In each round every tree takes its least outgoing edge, and trees halve at least."""
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w"), "edges")
    if edges.count() <= one_task:
        alone = lambda rows: rows.assign(taken=_kruskal(rows)[2]).query("taken")[["a", "b", "w"]]
        return _alone(edges, alone, "a bigint, b bigint, w double")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    label = written(nodes.select("node", F.col("node").alias("root")), "trees")
    left = written(edges.select("a", "b", "w").groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    taken = None
    while True:
        a, b = (label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        left = written(left.select("a", "b", "w").join(a, "a").join(b, "b").where("ra <> rb"), "outgoing")
        if left.isEmpty():
            break
        key = F.struct("w", "a", "b")
        ends = left.select("ra", key.alias("e")).unionByName(left.select(F.col("rb").alias("ra"), key.alias("e")))
        least = ends.groupBy("ra").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.w").distinct()
        taken = written(least if taken is None else taken.unionByName(least), "forest")
        joined = components(taken.select("a", "b"), one_task)
        label = written(nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "trees")
    return taken if taken is not None else left.select("a", "b", "w")


def segment(a: np.ndarray, b: np.ndarray, w: np.ndarray, coeff: float = 10.0, keep_singletons: bool = False) -> dict[int, int]:
    """Felzenszwalb's segmentation of one graph: node to the least node of its segment. Nodes without an edge taken are left out, or, with keep_singletons, segments of their own."""
    ids = np.unique(np.concatenate([a, b]))
    u, v = np.searchsorted(ids, a), np.searchsorted(ids, b)
    sets, used = DisjointSets(len(ids)), np.full(len(ids), keep_singletons)
    for i in np.lexsort((b, a, w)):
        p, q = sets.root(int(u[i])), sets.root(int(v[i]))
        if p != q and w[i] <= min(sets.energy[p] + coeff / sets.size[p], sets.energy[q] + coeff / sets.size[q]):
            sets.union(p, q, float(w[i]))
            used[[u[i], v[i]]] = True
    least: dict[int, int] = {}
    for k in np.flatnonzero(used):
        least.setdefault(sets.root(int(k)), int(ids[k]))
    return {int(ids[k]): least[sets.root(int(k))] for k in np.flatnonzero(used)}


def felzenszwalb(edges: DataFrame, coeff: float = 10.0, keep_singletons: bool = False, tiles: DataFrame | None = None) -> DataFrame:
    """(slide, n, label) of edges (slide, a, b, w): labels are gapless from 0 by the least tile of each segment. The method takes a slide's edges in order, so a slide is one task; tiles that no edge was taken for are left out, or, with keep_singletons, segments of their own. tiles (slide, n): with keep_singletons, those to label even where they have no edge."""
    if keep_singletons and tiles is not None:
        # An edge from a tile to itself joins nothing.
        n = F.col("n").cast("bigint")
        edges = edges.select("slide", "a", "b", "w").unionByName(tiles.select("slide", n.alias("a"), n.alias("b"), F.lit(0.0).alias("w")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = segment(rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["w"].to_numpy(float), coeff, keep_singletons)
        rank = {root: i for i, root in enumerate(sorted(set(of.values())))}
        return pd.DataFrame({"slide": rows["slide"].iloc[0], "n": list(of), "label": [rank[r] for r in of.values()]})

    return edges.groupBy("slide").applyInPandas(run, "slide string, n bigint, label bigint")


def segment_stack(members: DataFrame) -> DataFrame:
    """(slide, in_slide_id, global_id, population, features): the mean vector of each segment (slide, label), numbered over all slides from 0."""
    means = mean_vectors(members, ["slide", "label"]).withColumnRenamed("label", "in_slide_id")
    return numbered(means, ["slide", "in_slide_id"], "global_id").select("slide", "in_slide_id", "global_id", "population", "features")


def by_size(edges: DataFrame) -> DataFrame:
    """(slide, n, label, size) of the tiles of edges (slide, a, b): their components, the largest 0, then by the least tile."""
    key = lambda c: F.struct("slide", F.col(c).cast("long").alias("n"))
    ends = edges.select(key("a").alias("s"), key("b").alias("t"))
    ids = numbered(ends.select(F.col("s").alias("k")).unionByName(ends.select(F.col("t").alias("k"))).distinct().select("k.slide", "k.n"), ["slide", "n"], "id")
    a, b = (ids.select("slide", F.col("n").alias(c), F.col("id").alias(f"i{c}")) for c in "ab")
    found = components(edges.select("slide", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).join(a, ["slide", "a"]).join(b, ["slide", "b"]).select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    placed = ids.join(found, F.col("id") == F.col("node")).select("slide", "n", "root")
    sizes = placed.groupBy("slide", "root").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.withColumn("label", F.row_number().over(Window.partitionBy("slide").orderBy(F.col("size").desc(), "root")) - 1)
    return placed.join(ranked, ["slide", "root"]).select("slide", "n", F.col("label").cast("long").alias("label"), "size")
