"""Codes on the tile grid, and smoothing over each tile's neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The colours of codes 0 to 34 as code, red, green, blue.
COLOURS = """
0,0.22,0.2314,0.4745
1,0.3216,0.3294,0.6392
2,0.4196,0.4314,0.8118
3,0.6118,0.6200,0.8706
4,0.3882,0.4745,0.2236
5,0.5490,0.6353,0.3216
6,0.7098,0.8118,0.4200
7,0.8078,0.8588,0.6118
8,0.5490,0.4275,0.1922
9,0.7412,0.6196,0.2235
10,0.9059,0.7294,0.3216
11,0.9059,0.7961,0.5804
12,0.5176,0.2353,0.2235
13,0.6784,0.2863,0.2902
14,0.8392,0.3804,0.4196
15,0.9059,0.5882,0.6118
16,0.4824,0.2549,0.4510
17,0.6471,0.3176,0.5804
18,0.8706,0.6196,0.8392
19,0.2588,0.5098,0.7412
20,0.4196,0.6824,0.8431
21,0.6196,0.7922,0.8863
22,0.7765,0.8588,0.9373
23,0.9020,0.3333,0.0510
24,0.9373,0.5529,0.2392
25,0.9490,0.6824,0.4196
26,0.9647,0.8196,0.6353
27,0.2510,0.6392,0.3333
28,0.4549,0.7725,0.4667
29,0.6353,0.8549,0.6118
30,0.7804,0.9137,0.7529
31,0.4588,0.4196,0.6941
32,0.6196,0.6078,0.7843
33,0.7373,0.7451,0.8627
34,0.8549,0.8549,0.9216
"""

#: Cells of one neighbourhood that must agree, and the number beyond which background and negatives win too.
MOST, CLEAR = 5, 7


def colour_rows() -> list[tuple[int, float, float, float]]:
    return [(int(c), float(r), float(g), float(b)) for c, r, g, b in (x.split(",") for x in COLOURS.split())]


def code(render: bool = False, compat: bool = False) -> Column:
    """Code of a tile: 1 negative, else its cluster plus 2. render with compat: a tile counts as negative when its two nearest clusters are both 0, and rewritten clusters show through."""
    negative = (F.col("c1") == 0) & (F.col("c2") == 0) if render and compat else F.col("positive") == 0
    return F.when(negative, 1).otherwise(F.col("c1") + 2).cast("int")


def preview(tiles: DataFrame, grid: DataFrame, render: bool = False, compat: bool = False) -> DataFrame:
    """(slide, x, y, code) for every cell of the grid; 0 where there is no tile."""
    coded = tiles.select("slide", "x", "y", code(render, compat).alias("code"))
    return grid.select("slide", "x", "y").join(coded, ["slide", "x", "y"], "left").select("slide", "x", "y", F.coalesce("code", F.lit(0)).alias("code"))


def coloured(cells: DataFrame) -> DataFrame:
    """cells (code) with r, g, b; null where the code has no colour. The table has a fixed size."""
    table = cells.sparkSession.createDataFrame(colour_rows(), "code int, r double, g double, b double")
    return cells.join(F.broadcast(table), "code", "left")


def legend(labels: DataFrame) -> DataFrame:
    """(name, r, g, b) of labelled tiles, each once."""
    return labels.select("name", "r", "g", "b").distinct()


def neighbourhoods(cells: DataFrame, value: str) -> DataFrame:
    """(slide, x, y, around): for each cell whose eight neighbours exist, the nine values of its 3 x 3 block, by x, then y. One shuffle: each cell sends its value to the nine blocks it is in."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sent = cells.select("slide", "x", "y", F.col(value).alias("v"), F.explode(steps).alias("s"))
    sent = sent.select("slide", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.struct((-F.col("s.i")).alias("i"), (-F.col("s.j")).alias("j"), "v").alias("c"))
    blocks = sent.groupBy("slide", "x", "y").agg(F.array_sort(F.collect_list("c")).alias("c")).where(F.size("c") == 9)
    return blocks.select("slide", "x", "y", F.transform("c", lambda c: c["v"]).alias("around"))


def smoothed(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """tiles (slide, n, x, y, positive, c1, c2, c3) with c1 smoothed. A tile unlike all eight neighbours takes their most frequent code (the lowest of equals) if at least five of the nine cells have it: background or negative (c1 of -2 or -1) if at least seven, a cluster if it is the tile's second or third choice. All reads are of the codes before the pass; edge cells stay."""
    blocks = neighbourhoods(preview(tiles, grid), "code").withColumn("mine", F.get("around", F.lit(4)))
    lonely = blocks.where((F.col("mine") != 0) & (F.size(F.filter("around", lambda v: v == F.col("mine"))) == 1))
    ranked = F.array_sort(F.transform(F.array_distinct("around"), lambda v: F.struct((-F.size(F.filter("around", lambda w: w == v))).alias("k"), v.alias("code"))))
    winner = lonely.select("slide", "x", "y", F.get(ranked, F.lit(0)).alias("w")).select("slide", "x", "y", F.col("w.code").alias("_code"), (-F.col("w.k")).alias("_k")).where(F.col("_k") >= MOST)
    new = F.col("_code") - 2
    clear = F.col("_code").isin(0, 1) & (F.col("_k") >= CLEAR)
    chosen = F.when(clear | (new == F.col("c2")) | (new == F.col("c3")), new).otherwise(F.col("c1"))
    return tiles.join(winner, ["slide", "x", "y"], "left").withColumn("c1", F.coalesce(chosen, F.col("c1"))).drop("_code", "_k")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (tiles, to_background, to_negative, to_cluster): how many tiles (slide, n, c1) a pass changed, and to what."""
    old = before.select("slide", "n", F.col("c1").alias("_was"))
    met = after.select("slide", "n", "c1").join(old, ["slide", "n"])
    moved = F.col("c1") != F.col("_was")
    count = lambda to, name: F.count_if(moved & to).alias(name)
    return met.agg(F.count(F.lit(1)).alias("tiles"), count(F.col("c1") == -2, "to_background"), count(F.col("c1") == -1, "to_negative"), count(F.col("c1") >= 0, "to_cluster"))
