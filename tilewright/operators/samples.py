"""Samples, and distances within and between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.vectors import dot, mean_vectors, unit
from tilewright.operators._numbering import numbered
from tilewright.operators.cluster import distances


def with_replacement(rows: DataFrame, group: str, order: list[str], n: int = 32, seed: int = 7) -> DataFrame:
    """(rows, draw): all rows of a group of at most n, in order; else n draws with replacement."""
    sizes = rows.groupBy(group).agg((F.count(F.lit(1)) <= n).alias("_few"))
    sized = rows.join(sizes, group)
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    few = sized.where("_few").drop("_few").withColumn("draw", at.cast("int"))
    # A draw is the row whose hash with the draw's number is least: partial minima, no sort of a group.
    each = sized.where("not _few").drop("_few").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    drawn = each.groupBy(F.col(group).alias("_g"), "draw").agg(F.min(F.struct(random_key([*order, "draw"], seed).alias("h"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), whole.alias("r"))).alias("m"))
    return few.unionByName(drawn.select("m.r.*", "draw"))


def random_key(key: list[str], seed: int) -> object:
    """A random order that any engine can repeat: MD5 of the key's values and the seed."""
    return F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in key), F.lit(str(seed))).cast("binary"))


def random_of_each(rows: DataFrame, group: str, key: list[str], n: int, seed: int = 7) -> DataFrame:
    """At most n rows of each group, the first of a random order. A task keeps the first n of what it has of a group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(random_key(key, seed), *key))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def capped_images(rows: DataFrame, limit: int, key: list[str], seed: int = 7) -> DataFrame:
    """So many rows of a random order (a top-k, not a sort)."""
    return rows.orderBy(random_key(key, seed), *key).limit(limit)


def contact_sheet(drawn: DataFrame, columns: int) -> DataFrame:
    """drawn with row and col: a draw's place in a grid of so many columns."""
    return drawn.withColumn("row", F.expr(f"draw div {columns}").cast("int")).withColumn("col", (F.col("draw") % columns).cast("int"))


def cyclic(rows: DataFrame, key: list[str], size: int, batches: int, seed: int = 7) -> DataFrame:
    """rows with batch and place: the first so many batches of an endless walk round the rows in a random order, each of one size. A row is repeated as often as the walk meets it."""
    order = rows.withColumn("_h", random_key(key, seed))
    placed = numbered(order, ["_h", *key], "_i").drop("_h")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    met = placed.crossJoin(F.broadcast(n)).where(F.col("_i") < size * batches)
    at = met.withColumn("_at", F.explode(F.sequence(F.col("_i"), F.lit(size * batches - 1).cast("long"), F.col("_n"))))
    return at.withColumn("batch", F.expr(f"_at div {size}").cast("int")).withColumn("place", (F.col("_at") % size).cast("int")).drop("_i", "_n", "_at")


def class_sizes(found: DataFrame, classes: int = 2, largest: int = 1000) -> DataFrame:
    """(class, n, fit): the members of each class, and whether there are so many classes and the largest has so many members, as fine-tuning asks."""
    sizes = found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg((F.count(F.lit(1)) >= classes).alias("_enough"), (F.max("n") >= largest).alias("_large"))
    return sizes.crossJoin(F.broadcast(whole)).select("class", "n", (F.col("_enough") & F.col("_large")).alias("fit"))


def check_classes(found: DataFrame, classes: int = 2, largest: int = 1000) -> None:
    """Raises where class_sizes says that the classes aren't fit."""
    first = class_sizes(found, classes, largest).first()
    if first is None or not first.fit:
        raise ValueError(f"{classes} classes or more are needed, and {largest} members of the largest")


def intra_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, intra): the mean of 1 - the product of a row's unit vector with its class's mean unit vector."""
    units = rows.select(label, unit(F.col("features")).alias("features"))
    means = mean_vectors(units, [label]).select(F.col(label), F.col("features").alias("_m"))
    return units.join(means, label).groupBy(label).agg(F.avg(1 - dot(F.col("features"), F.col("_m"))).alias("intra"))


def inter_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, inter), a < b: 1 - the product of two classes' mean unit vectors."""
    means = mean_vectors(rows.select(label, unit(F.col("features")).alias("features")), [label])
    a, b = (means.select(F.col(label).alias(k), F.col("features").alias(f"v{k}")) for k in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (1 - dot(F.col("va"), F.col("vb"))).alias("inter"))


def nearest_samples(rows: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(centroid, sample): the row nearest to each centroid; the lower key of equals. A partial minimum a task."""
    flat = distances(rows, centroids).select(F.col(key).alias("_k"), F.explode(F.arrays_zip("ids", "dist")).alias("z"))
    least = flat.groupBy(F.col("z.ids").alias("centroid")).agg(F.min(F.struct(F.col("z.dist").alias("d"), F.col("_k").alias("k"))).alias("m"))
    return least.select("centroid", F.col("m.k").alias("sample"))


def reliable(rows: DataFrame, centroids: DataFrame, key: str, least: float = 0.75) -> DataFrame:
    """(key, label): rows whose cosine with the sample nearest to some centroid is above the bound, labelled by the centroid whose sample is closest (the lower id of equals). Centroids are few and are sent to all."""
    picks = nearest_samples(rows, centroids, key)
    chosen = rows.join(picks, F.col(key) == F.col("sample")).agg(F.array_sort(F.collect_list(F.struct("centroid", unit(F.col("features")).alias("v")))).alias("_c"))
    near = rows.select(key, unit(F.col("features")).alias("u")).crossJoin(F.broadcast(chosen))
    best = F.array_sort(F.transform("_c", lambda c: F.struct((-dot(F.col("u"), c["v"])).alias("s"), c["centroid"].alias("id"))))
    top = near.select(key, F.get(best, F.lit(0)).alias("b"))
    return top.where(-F.col("b.s") > least).select(key, F.col("b.id").alias("label"))


def one_hot(label: object, classes: int) -> object:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def export_plan(leaves: DataFrame, members: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """(node, leaf, slide, x, y): for each node of leaves (node, leaf) at most int(most / leaves of that node) random positions of each of its leaves; members: (global_id, slide, x, y). A node of more than `most` leaves has none, so its leaves meet no members; a leaf's order is the same under every node, so its members are put in order once."""
    quota = leaves.groupBy("node").agg(F.floor(F.lit(most) / F.count(F.lit(1))).alias("quota")).where("quota > 0")
    at = Window.partitionBy("global_id").orderBy(random_key(["slide", "x", "y"], seed), "slide", "x", "y")
    first = members.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= most).select(F.col("global_id").alias("leaf"), "slide", "x", "y", "_at")
    return leaves.join(quota, "node").join(first, "leaf").where("_at <= quota").select("node", "leaf", "slide", "x", "y")


def tree_export_plan(tree: DataFrame, members: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """As export_plan(), for all inner nodes of a tree: those whose population leaves each leaf a position are asked for their leaves, at most `most` rows a node, and not the long intervals above them, whose quota is 0."""
    from tilewright.operators.tree import leaves_under

    asked = tree.where(F.col("left").isNotNull() & (F.col("population") <= most)).select("node")
    return export_plan(leaves_under(tree, asked), members, most, seed)
