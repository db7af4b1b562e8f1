"""Merge trees of forests, without a task that holds a component.

A forest's edges, ranked, are taken in blocks of consecutive ranks. What a block's edges join is known once the lighter edges are contracted, which goes by halves: the edges of each lighter half are contracted to their components, each named by its
heaviest edge, for the heavier half beside it, then both halves are halved, until a half is a block: log2(blocks) rounds. A block's merges are then told by union-find over at most BLOCK edges, ids and sizes alone.

Leaves are laid out so that a node is an interval of them, the larger child first; then the nodes of one beginning are a heavy path. A block says how far each node lies from its own topmost node, and topmost nodes find theirs in the tree by pointer
doubling over blocks. Vectors meet the tree last: a node's mean is a difference of running sums over leaves, kept block by block, and its slides are those that entered its heavy path below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators._numbering import numbered
from tilewright.operators._tables import written
from tilewright.operators.graph import components

#: Edges of a block, and leaves whose running sums are kept together.
BLOCK, LEAVES = 1 << 18, 4096

EDGES = "rank bigint, u bigint, nu bigint, v bigint, nv bigint"


def _contracted(edges: DataFrame, n: int, block: int, blocks: int) -> DataFrame:
    """edges (EDGES) whose ends are what the edges before their block join them to: a vertex, or n plus the rank of its component's heaviest edge; with their sizes."""
    vertices = 2 * n
    for level in reversed(range(max(0, (blocks - 1).bit_length()))):
        pair = F.shiftright(F.floor(F.col("rank") / block), level + 1)
        light = F.shiftright(F.floor(F.col("rank") / block), level).bitwiseAND(1) == 0
        # A vertex of a pair of halves, as one number.
        placed = edges.withColumns({"light": light, "pu": pair * vertices + F.col("u"), "pv": pair * vertices + F.col("v")})
        lighter = placed.where("light")
        roots = components(lighter.select(F.col("pu").alias("a"), F.col("pv").alias("b")))
        sizes = lighter.select(F.col("pu").alias("node"), F.col("nu").alias("size")).unionByName(lighter.select(F.col("pv").alias("node"), F.col("nv").alias("size"))).groupBy("node").agg(F.max("size").alias("size"))
        heaviest = lighter.groupBy("pu").agg(F.max("rank").alias("rank")).select(F.col("pu").alias("node"), "rank")
        of = roots.join(sizes, "node").join(heaviest, "node", "left")
        whole = of.groupBy("root").agg(F.sum("size").alias("size"), (F.max("rank") + n).alias("top"))
        named = written(roots.join(whole, "root").select("node", "top", "size"), "contracted")
        u, v = (named.select(F.col("node").alias(f"p{c}"), F.col("top").alias(f"{c}_top"), F.col("size").alias(f"{c}_size")) for c in "uv")
        heavier = placed.where("not light").join(u, "pu", "left").join(v, "pv", "left")
        ends = [F.coalesce(f"{c}_{new}", old).alias(old) for c in "uv" for new, old in (("top", c), ("size", f"n{c}"))]
        edges = written(lighter.select("rank", "u", "nu", "v", "nv").unionByName(heavier.select("rank", *ends)), "half")
    return edges


INNER = "node bigint, lead bigint, follow bigint, u bigint, v bigint, size bigint, top bigint, off bigint, hung boolean"


def _merges(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """A block's merges, the least rank first: each new node (n + rank) with its children, u's and v's; and every node of the block with its topmost node in the block and the leaves before it there. Children from elsewhere (hung) have no children here."""
    rows = rows.sort_values("rank")
    up: dict[int, int] = {}
    size: dict[int, int] = {}
    made = []

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for rank, u, nu, v, nv in rows[["rank", "u", "nu", "v", "nv"]].itertuples(index=False):
        size.setdefault(u, nu)
        size.setdefault(v, nv)
        p, q, x = root(u), root(v), n + rank
        up[p] = up[q] = up[x] = x
        size[x] = size[p] + size[q]
        made.append((x, p, q))
    place: dict[int, tuple[int, int]] = {}
    inner = {x for x, _, _ in made}
    out = []
    for x, p, q in reversed(made):
        top, off = place.setdefault(x, (x, 0))
        big, small = (p, q) if (size[p], p) > (size[q], q) else (q, p)
        place[big], place[small] = (top, off), (top, off + size[big])
        out.append((x, big, small, p, q, size[x], top, off, False))
        out += [(c, None, None, None, None, size[c], *place[c], True) for c in (p, q) if c not in inner]
    return pd.DataFrame(out, columns=[c.split()[0] for c in INNER.split(", ")]).astype({c: "Int64" for c in ("lead", "follow", "u", "v")})


def merges(edges: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(node, u, v, size, root, off) of the merge trees of edges (rank from 0 without gaps, u, v) between vertices 0..n-1: vertices and merges (n + rank), the nodes that each merge joins (null for a vertex), the leaves below, the tree's root and the leaves before it in the tree."""
    count = edges.count()
    blocks = max(1, -(-count // block))
    one = F.lit(1).cast("long")
    cut = _contracted(edges.select("rank", "u", one.alias("nu"), "v", one.alias("nv")), n, block, blocks)
    parts = written(cut.groupBy(F.floor(F.col("rank") / block).alias("_b")).applyInPandas(lambda rows: _merges(rows, n), INNER), "merges")
    # Topmost nodes of blocks that hang in a heavier block, and where.
    hung = parts.where(f"hung and node >= {n}").select("node", "top", "off")
    state = written(hung.select("node", F.col("top").alias("up"), "off"), "hung") if blocks > 1 else None
    while state is not None:
        # Who hangs in one that hangs elsewhere goes twice as far.
        far = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("off").alias("more"))
        step = written(state.join(far, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("next").isNotNull().alias("moved")), "hung")
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    placed = parts.where(f"not hung or node < {n}").select("node", "u", "v", "size", "top", "off")
    if state is None:
        return placed.withColumnRenamed("top", "root")
    above = state.select(F.col("node").alias("top"), F.col("up").alias("root"), F.col("off").alias("more"))
    return placed.join(above, "top", "left").select("node", "u", "v", "size", F.coalesce("root", "top").alias("root"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))


def interval_sums(leaves: DataFrame, asked: DataFrame, block: int = LEAVES) -> DataFrame:
    """asked (node, enter, size) with total: the sum of the vectors of leaves (enter, features) from enter on, so many. Leaves are numbered from 0 without gaps. Sums run within blocks of leaves, so that little is lost in a difference."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("enter")
        sums = np.cumsum(np.array(rows["features"].tolist(), float), axis=0)
        return pd.DataFrame({"b": rows["b"], "enter": rows["enter"], "sums": sums.tolist(), "last": np.arange(len(rows)) == len(rows) - 1})

    b = F.floor(F.col("enter") / block).cast("long")
    within = written(leaves.withColumn("b", b).groupBy("b").applyInPandas(run, "b bigint, enter bigint, sums array<double>, last boolean"), "running")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            out = []
            for sums in batch.column(1).to_pylist():
                total = np.array(sums) if total is None else total + np.array(sums)
                out.append(total.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["b", "own", "upto"])

    # A row a block of leaves, in one task, one after the other.
    blocks = written(within.where("last").select("b", F.col("sums").alias("own")).repartition(1).sortWithinPartitions("b").mapInArrow(carry, "b bigint, own array<double>, upto array<double>"), "running")
    want = asked.withColumns({"_first": F.col("enter") - 1, "_last": F.col("enter") + F.col("size") - 1})
    want = want.withColumns({"_fb": F.floor(F.col("enter") / block).cast("long"), "_lb": F.floor(F.col("_last") / block).cast("long")})
    ends = within.select(F.col("enter").alias("_last"), F.col("sums").alias("_end"))
    starts = within.where(~F.col("last") | ((F.col("enter") + 1) % block != 0)).select(F.col("enter").alias("_first"), F.col("sums").alias("_start"))
    at_first = blocks.select(F.col("b").alias("_fb"), F.col("own").alias("_own"), F.col("upto").alias("_upto"))
    at_last = blocks.select((F.col("b") + 1).alias("_lb"), F.col("upto").alias("_before"))
    met = want.join(ends, "_last").join(starts, "_first", "left")
    short = met.where("_fb = _lb").select("node", "enter", "size", minus("_end", "_start").alias("total"))
    long = met.where("_fb <> _lb").join(at_first, "_fb").join(at_last, "_lb")
    sides = F.zip_with(minus("_own", "_start"), F.zip_with("_before", "_upto", lambda x, y: x - y), lambda x, y: x + y)
    return short.unionByName(long.select("node", "enter", "size", F.zip_with(sides, "_end", lambda x, y: x + y).alias("total")))


def minus(a: str, b: str) -> Column:
    """a - b, or a where there is no b."""
    return F.when(F.col(b).isNull(), F.col(a)).otherwise(F.zip_with(a, b, lambda x, y: x - y))


def entered(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, mark, since): which marks a heavy path has, and from which size of its nodes on. paths: (path, up, at), a path that hangs below the node of size `at` of path `up`, null for a root's. marks: (path, mark) of the leaf that each path ends in. A path's marks
    go to the path above, round by round; there are at most log2(leaves) paths above a leaf."""
    above = written(paths.where("up is not null"), "paths")
    now = written(marks.groupBy("path", "mark").agg(F.lit(1).cast("long").alias("since")), "marks")
    found = now
    while True:
        now = written(now.join(above, "path").groupBy(F.col("up").alias("path"), "mark").agg(F.min("at").alias("since")), "marks")
        if now.isEmpty():
            return found.groupBy("path", "mark").agg(F.min("since").alias("since"))
        found = found.unionByName(now)


def tree_of(forest: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """The concept trees of a spanning forest (a, b, w) over segments (id, slide, features); see tree.concept_tree."""
    roots = components(forest.select("a", "b"))
    leaves = written(numbered(roots.select(F.col("root").alias("tree"), F.col("node").alias("id")), ["tree", "id"], "leaf"), "leaves")
    n = leaves.count()
    starts = written(leaves.groupBy("tree").agg(F.min("leaf").alias("start")), "trees")
    ends = leaves.select("id", "leaf", "tree")
    u, v = ends.select(F.col("id").alias("a"), F.col("leaf").alias("u"), "tree"), ends.select(F.col("id").alias("b"), F.col("leaf").alias("v"))
    ranked = written(numbered(forest.select("a", "b", "w"), ["w", "a", "b"], "rank").join(u, "a").join(v, "b").select("rank", "tree", "u", "v", "w"), "ranked")
    told = written(merges(ranked, n, block), "nodes")
    # Names: a tree's k-th merge has the name of its k-th leaf plus the largest of all plus 1.
    largest = segments.agg((F.max("id") + 1).alias("_more"))
    order = numbered(ranked.select("tree", "rank", "w"), ["tree", "rank"], "_g")
    first = order.groupBy("tree").agg(F.min("_g").alias("_g0"))
    kth = order.join(first, "tree").join(starts, "tree").select("tree", "rank", "w", (F.col("_g") - F.col("_g0") + F.col("start")).alias("leaf"), "start")
    inner = kth.join(leaves.select("leaf", "id"), "leaf").crossJoin(F.broadcast(largest)).select((F.col("rank") + n).alias("vertex"), "tree", "start", "w", (F.col("id") + F.col("_more")).alias("name"))
    outer = leaves.join(starts, "tree").select(F.col("leaf").alias("vertex"), "tree", "start", F.lit(None).cast("double").alias("w"), F.col("id").alias("name"))
    names = written(inner.unionByName(outer), "names")
    own, left, right = names.withColumnRenamed("vertex", "node"), names.select(F.col("vertex").alias("u"), F.col("name").alias("left")), names.select(F.col("vertex").alias("v"), F.col("name").alias("right"))
    nodes = told.join(own, "node").join(left, "u", "left").join(right, "v", "left").select("tree", F.col("name").alias("node"), "left", "right", F.col("w").alias("weight"), F.col("size").alias("population"), (F.col("start") + F.col("off")).alias("enter"))
    nodes = written(nodes, "nodes")
    child = F.explode(F.array("left", "right")).alias("node")
    up = nodes.where("left is not null").select(child, F.col("node").alias("parent"), F.col("population").alias("at"), F.col("enter").alias("up"))
    nodes = written(nodes.join(up, "node", "left"), "nodes")
    # Vectors and slides of the leaves, by their places.
    placed = written(nodes.where("left is null").select("node", "enter").join(segments.select(F.col("id").alias("node"), "slide", F.col("features").cast("array<double>").alias("features")), "node"), "placed")
    sums = interval_sums(placed.select("enter", "features"), nodes.where("left is not null").select("node", "enter", F.col("population").alias("size")))
    means = sums.select("node", F.transform("total", lambda x: x / F.col("size")).alias("descriptor")).unionByName(placed.select("node", F.col("features").alias("descriptor")))
    paths = nodes.where("parent is null or up <> enter").select(F.col("enter").alias("path"), "up", "at")
    slides = entered(paths, placed.select(F.col("enter").alias("path"), F.col("slide").alias("mark")))
    sets = nodes.select("node", F.col("enter").alias("path"), "population").join(slides, "path").where("population >= since").groupBy("node").agg(F.array_sort(F.collect_list("mark")).alias("slides"))
    return nodes.join(means, "node").join(sets, "node", "left").select("tree", "node", "parent", "left", "right", "weight", "population", "descriptor", F.coalesce("slides", F.array().cast("array<string>")).alias("slides"), "enter")
