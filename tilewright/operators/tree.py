"""Concept trees: binary merge trees over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.vectors import dot
from tilewright.operators._numbering import running
from tilewright.operators._tables import written
from tilewright.operators.dendrogram import BLOCK, tree_of

TREE = "tree bigint, node bigint, parent bigint, left bigint, right bigint, weight double, population bigint, descriptor array<double>, slides array<string>"


def concept_tree(forest: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """One binary tree for each component of a minimum spanning forest (a, b, w) over segments (id, slide, features). Its edges merge their ends' trees, the least first; a merge is a new node with the summed population, the mean of its descriptors by population, and the union of slides. Segments are nodes by their ids; a component's k-th merge gets its k-th smallest id plus the largest id of all plus 1, so that its root has its largest number. enter is the place of a node's first leaf where leaves are laid out so that a node is an interval of them, its larger child first. No task holds a component: see dendrogram."""
    return tree_of(forest, segments, block)


def nested(tree: DataFrame) -> DataFrame:
    """tree (node, left, right, population) with enter, where it has none: the place of each node's first leaf, the larger child first, trees one after the other. Each node looks twice as far up in each round, so rounds grow with the logarithm of the depth."""
    if "enter" in tree.columns:
        return tree
    inner = _children(tree)
    big = (F.col("pop_left") > F.col("pop_right")) | ((F.col("pop_left") == F.col("pop_right")) & (F.col("left") > F.col("right")))
    first, second = F.when(big, F.col("left")).otherwise(F.col("right")), F.when(big, F.col("right")).otherwise(F.col("left"))
    two = F.array(F.struct(first.alias("node"), F.lit(0).cast("long").alias("off")), F.struct(second.alias("node"), F.greatest("pop_left", "pop_right").cast("long").alias("off")))
    state = written(inner.select(F.col("node").alias("up"), F.explode(two).alias("c")).select("c.node", "up", "c.off"), "above")
    while True:
        far = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("off").alias("more"))
        step = written(state.join(far, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("next").isNotNull().alias("moved")), "above")
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    roots = tree.join(state, "node", "left_anti").select("node", F.col("population").cast("long").alias("population"))
    starts = running(roots, ["node"], "population", "_end").select(F.col("node").alias("_root"), (F.col("_end") - F.col("population")).alias("_start"))
    placed = state.select("node", F.col("up").alias("_root"), "off").unionByName(roots.select("node", F.col("node").alias("_root"), F.lit(0).cast("long").alias("off")))
    enter = placed.join(starts, "_root").select("node", (F.col("_start") + F.col("off")).alias("enter"))
    return written(tree.join(enter, "node").select(*tree.columns, "enter"), "nested")


def _children(tree: DataFrame) -> DataFrame:
    """Inner nodes with their children's populations."""
    left = tree.select(F.col("node").alias("left"), F.col("population").alias("pop_left"))
    right = tree.select(F.col("node").alias("right"), F.col("population").alias("pop_right"))
    return tree.where("left is not null").join(left, "left").join(right, "right")


def truncated_leaves(tree: DataFrame, least: int) -> DataFrame:
    """(node, population): nodes of at least so many members whose children both have fewer; leaves of the tree if they have as many."""
    inner = _children(tree).where((F.col("population") >= least) & (F.col("pop_left") < least) & (F.col("pop_right") < least))
    leaves = tree.where(F.col("left").isNull() & (F.col("population") >= least))
    return inner.select("node", "population").unionByName(leaves.select("node", "population"))


#: Places of an interval that are spelt out at once.
SPAN = 4096


def leaves_under(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, leaf): the leaves below each of nodes. A node is an interval of leaves, so its places, spelt out, meet the leaves by an equi-join: a row for each row of the result, and no loop over levels."""
    own = nested(tree)
    asked = own.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "enter", "population")
    # In two steps, so that no row holds a large interval's places.
    parts = asked.select("node", F.explode(F.sequence(F.col("enter"), F.col("enter") + F.col("population") - 1, F.lit(SPAN).cast("long"))).alias("from"), (F.col("enter") + F.col("population")).alias("to"))
    places = parts.select("node", F.explode(F.sequence("from", F.least(F.col("from") + SPAN, "to") - 1)).alias("enter"))
    return places.join(own.where("left is null").select("enter", F.col("node").alias("leaf")), "enter").select("node", "leaf")


def significant_tree(tree: DataFrame) -> DataFrame:
    """(tree, node, parent, left, right, population): each tree reduced to its significant forks: from the root, a node's children are the two sides of the fork below it, down the larger children, whose smaller side is largest (the deepest of equals), and so on from both; all nodes that remain keep their populations.

    Nodes that begin at one place are a heavy path. Walks down it take just the forks whose smaller side is larger than any below on the path, so these are told by a running maximum; what hangs at other forks goes, with all below it, which is what the running maximum of ends over places says."""
    own = nested(tree).select("tree", "node", "left", "right", "population", "enter")
    small = F.least(F.struct(F.col("pop_left").alias("p"), F.col("left").alias("n")), F.struct(F.col("pop_right").alias("p"), F.col("right").alias("n")))
    big = F.greatest(F.struct(F.col("pop_left").alias("p"), F.col("left").alias("n")), F.struct(F.col("pop_right").alias("p"), F.col("right").alias("n")))
    forks = _children(own).select("node", small.alias("small"), big.alias("big"))
    rows = own.join(forks, "node", "left")
    # In the order of places and sizes, the largest of all forks so far is one of the own path, if that has any yet; of equals the deepest.
    fork = F.struct("enter", F.col("small.p").alias("p"), (-F.col("population")).alias("up"), F.col("small.n").alias("left"), F.col("big.n").alias("right"))
    told = running(rows.withColumn("_value", F.when(F.col("small").isNotNull(), fork)), ["enter", "population"], "_value", "_fork", "max")
    ends = F.when(F.col("_fork.enter") == F.col("enter"), F.col("_fork"))
    rows = written(told.withColumn("_fork", ends).withColumn("fork", F.col("small").isNotNull() & F.coalesce(F.col("_fork.up") == -F.col("population"), F.lit(False))).drop("_value"), "forks")
    # Walks start at the top of a path and at the larger side of each fork taken.
    sides = rows.where("small is not null").select(F.col("small.n").alias("node")).unionByName(rows.where("fork").select(F.col("big.n").alias("node")))
    roots = rows.join(rows.where("left is not null").select(F.explode(F.array("left", "right")).alias("node")), "node", "left_anti").select("node")
    starts = rows.join(sides.unionByName(roots), "node", "left_semi").select("tree", "node", "population", "enter", F.col("_fork.left").alias("left"), F.col("_fork.right").alias("right"))
    starts = written(starts, "walks")
    gone = rows.where("small is not null and not fork").select(F.col("small.n").alias("node")).join(own.select("node", "enter", "population"), "node").select("enter", (F.col("enter") + F.col("population")).alias("end"))
    # Ends of what goes, at each path's place: a path whose place lies before such an end goes too.
    marks = starts.select("enter").distinct().withColumn("end", F.lit(None).cast("long")).unionByName(gone).groupBy("enter").agg(F.max("end").alias("end"))
    lost = running(marks, ["enter"], "end", "_end", "max").where("_end > enter").select("enter")
    kept = starts.join(lost, "enter", "left_anti")
    parents = kept.where("left is not null").select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    return kept.join(parents, "node", "left").select("tree", "node", "parent", "left", "right", "population")


#: Share of pairs that is under the rounding of their sum.
LEFT = 2.0**-60


def similarity(a: DataFrame, b: DataFrame, root_a: int, root_b: int) -> DataFrame:
    """One row (score): where either node is a leaf, the product of the two descriptors; else half the sum over the pairing of the children with the larger summed product (the straight one of equals). Pairs of nodes go down level by level, each by joins. A pair's share halves with each level, so after some 60 levels more than the logarithm of the leaves what is left, less than LEFT of the product of the largest lengths, is under the rounding of the sum, and the walk ends."""
    def side(tree: DataFrame, name: str) -> DataFrame:
        own = tree.select("node", "left", "right", F.col("descriptor").alias("v"))
        left, right = (tree.select(F.col("node").alias(c), F.col("descriptor").alias(f"v_{c}")) for c in ("left", "right"))
        full = own.join(left, "left", "left").join(right, "right", "left")
        return full.select(*(F.col(c).alias(f"{name}_{c}") for c in ("node", "left", "right", "v", "v_left", "v_right")))

    left, right = side(a, "a"), side(b, "b")
    spark = a.sparkSession
    pairs = spark.createDataFrame([(root_a, root_b, 1.0)], "a_node bigint, b_node bigint, share double")
    scores = None
    while True:
        met = written(pairs.join(left, "a_node").join(right, "b_node"), "pairs")
        ends = F.col("a_left").isNull() | F.col("b_left").isNull()
        got = met.where(ends).select((F.col("share") * dot(F.col("a_v"), F.col("b_v"))).alias("s"))
        scores = got if scores is None else scores.unionByName(got)
        straight = dot(F.col("a_v_left"), F.col("b_v_left")) + dot(F.col("a_v_right"), F.col("b_v_right"))
        crossed = dot(F.col("a_v_left"), F.col("b_v_right")) + dot(F.col("a_v_right"), F.col("b_v_left"))
        first = F.when(straight >= crossed, F.col("b_left")).otherwise(F.col("b_right"))
        second = F.when(straight >= crossed, F.col("b_right")).otherwise(F.col("b_left"))
        two = F.explode(F.array(F.struct(F.col("a_left").alias("a"), first.alias("b")), F.struct(F.col("a_right").alias("a"), second.alias("b"))))
        pairs = met.where(~ends).select(two.alias("p"), "share").select(F.col("p.a").alias("a_node"), F.col("p.b").alias("b_node"), (F.col("share") / 2).alias("share"))
        if (pairs.agg(F.sum("share")).first()[0] or 0.0) <= LEFT:
            return scores.agg(F.sum("s").alias("score"))
