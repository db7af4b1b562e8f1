"""Tiles, grids, runs and trees derived from the general tables, so that every operator has an input whose result SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.vectors import mean_vectors


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, n, x, y, positive, label, features): vectors on 10 x 10 grids."""
    e = read(spark, sf_dir, "embeddings").where("label <> 9")
    n = F.col("vec_id") % 100
    return e.select(
        F.concat(F.lit("S"), F.expr("vec_id div 100").cast("string")).alias("slide"),
        n.cast("int").alias("n"),
        F.expr("(vec_id % 100) div 10").cast("int").alias("x"),
        (n % 10).cast("int").alias("y"),
        F.when(F.col("label") != 8, 1).otherwise(0).alias("positive"),
        "label",
        F.transform("embedding", lambda v: v.cast("double") * 40).alias("features"),
        "vec_id",
    )


PATCHES = """patch as (select 'S' || (vec_id // 100)::varchar as slide, (vec_id % 100)::int as n, ((vec_id % 100) // 10)::int as x, (vec_id % 10)::int as y,
  case when label <> 8 then 1 else 0 end as positive, label, list_transform(embedding, lambda v: v::double * 40) as features, vec_id
  from embeddings where label <> 9)"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_vectors(patches(spark, sf_dir).where("label < 8"), ["label"]).select(F.col("label").alias("id"), "features")


CENTROIDS = (
    PATCHES
    + """, flat as (select label, unnest(features) as v, generate_subscripts(features, 1) as pos, positive from patch),
centroid as (select label as id, list(m order by pos) as features from (select label, pos, avg(v) as m from flat where label < 8 group by 1, 2) group by 1)"""
)

ASSIGNED = (
    CENTROIDS
    + """, ranked as (select p.slide, p.n, p.x, p.y, p.positive, p.label, c.id, list_distance(p.features, c.features) as d,
  row_number() over (partition by p.slide, p.n order by list_distance(p.features, c.features), c.id) as r from patch p, centroid c where p.positive = 1),
assigned as (select slide, n, x, y, positive, label, max(id) filter (r = 1) as c1, max(id) filter (r = 2) as c2, max(id) filter (r = 3) as c3,
  max(d) filter (r = 1) as d1, max(d) filter (r = 2) as d2, max(d) filter (r = 3) as d3, list(d order by id) as dist from ranked group by all)"""
).replace("group by all)", "group by slide, n, x, y, positive, label)")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.operators.cluster import nearest

    return nearest(patches(spark, sf_dir).where("positive = 1"), centroids(spark, sf_dir))


def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, n, x, y, positive, c1, c2, c3): coherent clusters with noise on 20 x 20 grids."""
    cells = (
        read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 10).cast("int").alias("s"), (F.col("l_partkey") % 20).cast("int").alias("x"), (F.col("l_orderkey") % 20).cast("int").alias("y"))
        .agg((F.sum(F.col("l_quantity").cast("long")) + F.count(F.lit(1))).alias("h"))
    )
    made = cells.selectExpr("*", "x div 5 as gx", "y div 5 as gy", "h % 7 = 0 as noise", "h % 14 = 0 as noise2").selectExpr("*", "cast((gx + gy) % 6 as int) as base")
    made = made.where("not (h % 13 = 0 or (gx = 3 and gy = 3 and not noise))").selectExpr(*GRID)
    return made.selectExpr("slide", "cast(x * 20 + y as int) as n", "x", "y", "positive", "c1", "case when positive = 0 then 0 else c2 end as c2", "case when positive = 0 then 0 else c3 end as c3")


#: Columns of the noisy grid, in SQL that both engines read.
GRID = (
    "concat('G', cast(s as string)) as slide",
    "x",
    "y",
    "case when (gx = 0 and gy = 3 and not noise) or h % 11 = 0 then 0 else 1 end as positive",
    "case when noise then (base + 3) % 6 else base end as c1",
    "case when noise2 then (base + 1) % 6 when noise then base else (base + 1) % 6 end as c2",
    "case when noise2 then base when noise then (base + 1) % 6 else (base + 2) % 6 end as c3",
)

GRID_TILES = f"""cell as (select (l_suppkey % 10)::int as s, (l_partkey % 20)::int as x, (l_orderkey % 20)::int as y, (sum(l_quantity::bigint) + count(*))::bigint as h from lineitem group by 1, 2, 3),
made as (select *, x // 5 as gx, y // 5 as gy, h % 7 = 0 as noise, h % 14 = 0 as noise2, (((x // 5) + (y // 5)) % 6)::int as base from cell),
drawn as (select {", ".join(GRID)} from made where not (h % 13 = 0 or (gx = 3 and gy = 3 and not noise))),
tile as (select slide, (x * 20 + y)::int as n, x, y, positive, c1, case when positive = 0 then 0 else c2 end as c2, case when positive = 0 then 0 else c3 end as c3 from drawn),
grid as (select s.slide, a.x, b.y from (select distinct slide from tile) s, (select unnest(range(0, 20))::int as x) a, (select unnest(range(0, 20))::int as y) b)"""


def grid_cells(tiles: DataFrame) -> DataFrame:
    from tilewright.operators.tiles import tile_grid

    return tile_grid(tiles.select("slide").distinct().select("slide", F.lit(20).alias("nx"), F.lit(20).alias("ny")))


#: Runs of clusterings: which dimensions (from 0) each looks at.
VIEWS = {0: (0, 63, 1), 1: (0, 31, 1), 2: (32, 63, 1), 3: (0, 62, 2), 4: (1, 63, 2)}


def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, slide, n, label): the nearest centroid in five views of the vectors."""
    from tilewright.operators.cluster import nearest

    rows, centres = patches(spark, sf_dir).where("positive = 1"), centroids(spark, sf_dir)
    out = None
    for run, (a, b, step) in VIEWS.items():
        cut = lambda f, a=a, b=b, step=step: F.transform(F.sequence(F.lit(a), F.lit(b), F.lit(step)), lambda k: F.get(f, k))
        seen = nearest(rows.withColumn("features", cut(F.col("features"))), centres.withColumn("features", cut(F.col("features"))), 1)
        own = seen.select(F.lit(run).alias("run"), "slide", "n", F.col("c1").alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


RUNS = (
    CENTROIDS
    + ", view as ("
    + " union all ".join(f"select {r} as run, list_transform(range({a}, {b} + 1, {s}), lambda k: (k + 1)::int) as at" for r, (a, b, s) in VIEWS.items())
    + """), runs as (select run, slide, n, id as label from (select v.run, p.slide, p.n, c.id, row_number() over (partition by v.run, p.slide, p.n
  order by list_distance(list_transform(v.at, lambda k: p.features[k]), list_transform(v.at, lambda k: c.features[k])), c.id) as r
  from patch p, centroid c, view v where p.positive = 1) where r = 1)"""
)

#: A fixed tree of 15 nodes: node, left, right, population; leaves 0 to 7, root 14.
TREE_ROWS = [(0, None, None, 1), (1, None, None, 1), (2, None, None, 1), (3, None, None, 1), (4, None, None, 1), (5, None, None, 1), (6, None, None, 1), (7, None, None, 1), (8, 0, 1, 2), (9, 2, 8, 3), (10, 3, 4, 2), (11, 9, 10, 5), (12, 5, 6, 2), (13, 7, 12, 3), (14, 11, 13, 8)]


def tree(spark: SparkSession, shift: float = 0.0) -> DataFrame:
    """TREE_ROWS with parents and descriptors."""
    parent = {c: n for n, a, b, _ in TREE_ROWS for c in (a, b) if c is not None}
    rows = [(0, n, parent.get(n), a, b, 1.0 * n, p, [1.0 * n + shift, 2.0 - n * shift, 0.5], ["S0"]) for n, a, b, p in TREE_ROWS]
    from tilewright.operators.tree import TREE

    return spark.createDataFrame(rows, TREE)
