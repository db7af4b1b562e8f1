"""Every query of the library by name, with the SQL that it must agree with. Floats are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import names, pixels
from tilewright.functions.vectors import dot, mean_vectors, norm, softmax
from tilewright.operators import cluster, compare, consensus, graph, minibatch, models, reduction, samples, smooth, tiles
from tilewright.operators import tree as trees
from tilewright.operators._tables import written
from tilewright.plans import fixtures as fx
from tilewright.sources import writers
from tilewright.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _text(vector: str | Column, digits: int = 5) -> Column:
    """A vector as text, so that values hash alike."""
    return F.array_join(F.transform(vector, lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + F.lit(0.0))), ",")


def _sql_text(vector: str, digits: int = 5) -> str:
    return f"array_to_string(list_transform({vector}, lambda v: printf('%.{digits}f', round(v, {digits}) + 0.0)), ',')"


# Tiles


@query(f"with {fx.PATCHES} select slide, x, y, row_number() over (partition by slide order by x, y) - 1 as n from patch")
def patch_numbering(spark: SparkSession, d: str) -> DataFrame:
    return tiles.number_tiles(fx.patches(spark, d).select("slide", "x", "y")).select("slide", "x", "y", F.col("n").cast("long").alias("n"))


@query(
    """with s as (select 'P' || s_suppkey::varchar as slide, (s_suppkey % 7)::int as nx, (s_suppkey % 5)::int as ny from supplier)
    select slide, x, y from s, lateral (select unnest(range(0, nx))::int as x) a, lateral (select unnest(range(0, ny))::int as y) b"""
)
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    slides = fx.read(spark, d, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("slide"), (F.col("s_suppkey") % 7).cast("int").alias("nx"), (F.col("s_suppkey") % 5).cast("int").alias("ny"))
    return tiles.tile_grid(slides)


@query(
    f"""with {fx.PATCHES}, p as (select format('{{}}.PDL1.mrxs#{{}}-level16-{{}}-{{}}.jpg', slide, n, x, y) as path from patch)
    select path, regexp_extract(path, '^(.+)#', 1) as slide, regexp_extract(path, '#([0-9]+)-', 1)::int as n, regexp_extract(path, 'level([0-9]+)-', 1)::int as level,
      regexp_extract(path, '-([0-9]+)-[0-9]+[.]jpg$', 1)::int as x, regexp_extract(path, '-([0-9]+)[.]jpg$', 1)::int as y from p"""
)
def patch_name_parse(spark: SparkSession, d: str) -> DataFrame:
    named = tiles.named(fx.patches(spark, d).withColumn("slide", F.concat("slide", F.lit(".PDL1.mrxs"))))
    return named.select("path", names.parsed(F.concat(F.lit("file:/a%23/"), F.replace(F.col("path"), F.lit("#"), F.lit("%23")))).alias("t")).select("path", "t.*")


@query("select p_partkey as id, p_size as tissue, 100 as area from part where p_size > 0.25 * 100")
def tissue_filter(spark: SparkSession, d: str) -> DataFrame:
    return tiles.with_tissue(fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("tissue"), F.lit(100).alias("area")))


@query(
    """select user_id, count(*) filter (v between -1 + 2 * 85 / 256.0::double and 1) > 10 as positive
    from (select user_id, (value::decimal(18, 2)::double % 300) / 100 - 1.5 as v from events) group by 1"""
)
def stain_filter(spark: SparkSession, d: str) -> DataFrame:
    values = fx.read(spark, d, "events").select("user_id", (F.col("value").cast("decimal(18,2)").cast("double") % 300 / 100 - 1.5).alias("v"))
    return values.groupBy("user_id").agg(F.collect_list("v").alias("v")).select("user_id", pixels.stained(F.col("v")).alias("positive"))


_INVERSE = pixels._inverse(pixels.STAINS)


@query(
    f"""select p_partkey as id, round(-ln(r / 255.0 + 2) * {_INVERSE[0][2]!r}::double - ln(g / 255.0 + 2) * {_INVERSE[1][2]!r}::double - ln(b / 255.0 + 2) * {_INVERSE[2][2]!r}::double, 6) as dab,
      round(0.2125::double * r + 0.7154::double * g + 0.0721::double * b, 6) as grey, round(r / 127.5::double - 1, 6) as scaled
    from (select p_partkey, (p_partkey % 256)::double as r, (p_size * 5 % 256)::double as g, (p_partkey * 7 % 256)::double as b from part)"""
)
def stain_channels(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("double").alias("r"), (F.col("p_size") * 5 % 256).cast("double").alias("g"), (F.col("p_partkey") * 7 % 256).cast("double").alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select(F.col("p_partkey").alias("id"), _round(pixels.stain(r, g, b, 2)).alias("dab"), _round(pixels.grey(r, g, b)).alias("grey"), _round(pixels.scaled(r)).alias("scaled"))


@query(f"with {fx.PATCHES}, {fx.GRID_TILES} select t.slide, t.n, p.label from tile t join patch p on t.n = p.n and replace(t.slide, 'G', 'S') = p.slide where t.positive = 1")
def positive_features(spark: SparkSession, d: str) -> DataFrame:
    chosen = fx.grid_tiles(spark, d).where("positive = 1").select("slide", "n")
    features = fx.patches(spark, d).withColumn("slide", F.replace(F.col("slide"), F.lit("S"), F.lit("G")))
    return chosen.join(features, ["slide", "n"]).select("slide", "n", "label")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as r from orders) where (r - 1) % 50 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return tiles.systematic_sample(fx.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r <= 3")
def prefix_of_each(spark: SparkSession, d: str) -> DataFrame:
    return tiles.first_of_each(fx.read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


@query(f"with {fx.PATCHES} select slide, n from patch where slide in (select slide from patch where label = 3)")
def slide_subset(spark: SparkSession, d: str) -> DataFrame:
    p = fx.patches(spark, d).select("slide", "n", "label")
    return tiles.on_slides(p, p.where("label = 3")).select("slide", "n")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)")
def pending_outputs(spark: SparkSession, d: str) -> DataFrame:
    done = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tiles.pending(fx.read(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


_WORDS = "word as (select l_suppkey as image, ((l_partkey * 7 + l_orderkey * 3) % 256)::int as w from lineitem)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), ((F.col("l_partkey") * 7 + F.col("l_orderkey") * 3) % 256).cast("int").alias("word"))


@query(
    f"""with {_WORDS}, c as (select image, w, count(*) as n from word group by 1, 2), k as (select unnest(range(0, 256))::int as w), i as (select distinct image from word)
    select i.image, array_to_string(list(coalesce(c.n, 0)::varchar order by k.w), ',') as histogram from i cross join k left join c on c.image = i.image and c.w = k.w group by 1"""
)
def visual_word_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pixels.word_histograms(_words(spark, d), "image").select("image", F.array_join("histogram", ",").alias("histogram"))


@query(
    f"""with {_WORDS}, m as (select image, min(w)::double as a, max(w)::double as b from word group by 1),
    e as (select image, case when a = b then a - 0.5 else a end as lo, case when a = b then b + 0.5 else b end as hi from m),
    g as (select word.image, w, lo, (hi - lo) / 255 as step, least(floor((w - lo) / (hi - lo) * 255)::int, 254) as i from word join e using (image)),
    f as (select *, i - case when w < i * step + lo then 1 else 0 end as j from g),
    h as (select image, j + case when j < 254 and w >= (j + 1) * step + lo then 1 else 0 end as bin, count(*) as n from f group by 1, 2),
    k as (select unnest(range(0, 255))::int as bin), s as (select image from m)
    select s.image, array_to_string(list(coalesce(h.n, 0)::varchar order by k.bin), ',') as histogram from s cross join k left join h on h.image = s.image and h.bin = k.bin group by 1"""
)
def visual_word_histogram_compat(spark: SparkSession, d: str) -> DataFrame:
    return pixels.word_histograms(_words(spark, d), "image", compat=True).select("image", F.array_join("histogram", ",").alias("histogram"))


# Clusters


@query(
    f"""with {fx.PATCHES}, flat as (select slide, label, unnest(features) as v, generate_subscripts(features, 1) as pos from patch),
    m as (select slide, label, pos, avg(v) as m, count(*) as population from flat group by 1, 2, 3)
    select slide, label, max(population) as population, {_sql_text("list(m order by pos)")} as mean from m group by 1, 2"""
)
def label_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    return mean_vectors(fx.patches(spark, d), ["slide", "label"]).select("slide", "label", "population", _text("features").alias("mean"))


@query(f"with {fx.ASSIGNED} select slide, n, c1, c2, c3, round(d1, 6) as d1, round(d2, 6) as d2, round(d3, 6) as d3, {_sql_text('dist')} as dist from assigned")
def nearest_centroids_top3(spark: SparkSession, d: str) -> DataFrame:
    return fx.assigned(spark, d).select("slide", "n", "c1", "c2", "c3", _round("d1").alias("d1"), _round("d2").alias("d2"), _round("d3").alias("d3"), _text("dist").alias("dist"))


_SWAP = "select slide, n, case when {0} then c2 when {1} then c3 else c1 end as c1, case when {0} then c1 else c2 end as c2, case when {0} then c3 when {1} then c1 else c3 end as c3 from assigned"


@query(f"with {fx.ASSIGNED} " + _SWAP.format("(c1 >= 3 and c2 < 3 and d2 - d1 <= 1)", "(c1 >= 3 and c3 < 3 and d3 - d1 <= 1)"))
def labelled_preference(spark: SparkSession, d: str) -> DataFrame:
    return cluster.labelled_preference(fx.assigned(spark, d), 3).select("slide", "n", "c1", "c2", "c3")


@query(f"with {fx.ASSIGNED} " + _SWAP.format("(c1 >= 3 and c2 < 3 and d2 - d1 <= 1)", "(c1 >= 3 and c3 < 3 and d2 - d1 > 1 and d3 - d1 <= 1)"))
def labelled_preference_compat(spark: SparkSession, d: str) -> DataFrame:
    return cluster.labelled_preference(fx.assigned(spark, d), 3, compat=True).select("slide", "n", "c1", "c2", "c3")


_SEEDED = """, seed as (select (row_number() over (order by slide, n) - 1)::int as id, features from patch where label = 8),
    every as (select id, features from seed union all select (id + (select max(id) + 1 from seed))::int, features from centroid),
    r as (select p.slide, p.n, e.id, list_distance(p.features, e.features) as d, row_number() over (partition by p.slide, p.n order by list_distance(p.features, e.features), e.id) as r
      from patch p, every e where p.positive = 1),
    assigned as (select slide, n, max(id) filter (r = 1) as c1, max(id) filter (r = 2) as c2, max(id) filter (r = 3) as c3, max(d) filter (r = 1) as d1,
      max(d) filter (r = 2) as d2, max(d) filter (r = 3) as d3, (select max(id) + 1 from seed) as k from r group by 1, 2) """


@query(f"with {fx.CENTROIDS}{_SEEDED}" + _SWAP.format("(c1 >= k and c2 < k and d2 - d1 <= 1)", "(c1 >= k and c3 < k and d3 - d1 <= 1)"))
def semi_supervised_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = fx.patches(spark, d)
    seeds = tiles.numbered(p.where("label = 8").select("slide", "n", "features"), ["slide", "n"], "id")
    found = cluster.nearest_of_many(p.where("positive = 1"), cluster.seeded(seeds, fx.centroids(spark, d)))
    return cluster.labelled_preference(found, seeds.count()).select("slide", "n", "c1", "c2", "c3")


@query(
    f"""with {fx.ASSIGNED}, a as (select slide, n, case when dist is null then null else list_transform(dist, lambda v: exp(d1 - v)) end as e from assigned), t as (select p.slide, p.x, p.y, case when p.positive = 1
      then list_concat([0.0::double], list_transform(a.e, lambda v: v / list_sum(a.e))) else [1.0::double, 0, 0, 0, 0, 0, 0, 0, 0] end as p from patch p left join a using (slide, n)),
    s as (select unnest([-1, 0, 1]) as i), w as (select a.slide, a.x, a.y, i.i, j.i as j, b.p from t a, s i, s j, t b where b.slide = a.slide and b.x = a.x + i.i and b.y = a.y + j.i)
    select slide, x, y, {_sql_text("flatten(list(p order by i, j))", 4)} as features from w group by 1, 2, 3 having count(*) = 9"""
)
def hierarchical_features(spark: SparkSession, d: str) -> DataFrame:
    seen = cluster.nearest(fx.patches(spark, d), fx.centroids(spark, d))
    return cluster.hierarchical_features(seen).select("slide", "x", "y", _text("features", 4).alias("features"))


@query(
    f"""with {fx.ASSIGNED}, f1 as (select a.c1 as id, unnest(p.features) as v, generate_subscripts(p.features, 1) as pos from assigned a join patch p using (slide, n)),
    m1 as (select id, list(m order by pos) as features from (select id, pos, avg(v) as m from f1 group by 1, 2) group by 1),
    r2 as (select p.slide, p.n, m.id, row_number() over (partition by p.slide, p.n order by list_distance(p.features, m.features), m.id) as r from patch p, m1 m where p.positive = 1),
    f2 as (select r2.id, unnest(p.features) as v, generate_subscripts(p.features, 1) as pos from r2 join patch p using (slide, n) where r = 1),
    m2 as (select id, list(m order by pos) as features from (select id, pos, avg(v) as m from f2 group by 1, 2) group by 1),
    r3 as (select p.slide, p.n, m.id, row_number() over (partition by p.slide, p.n order by list_distance(p.features, m.features), m.id) as r from patch p, m2 m where p.positive = 1)
    select slide, n, id as label from r3 where r = 1"""
)
def lloyd_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.lloyd(fx.patches(spark, d).where("positive = 1"), fx.centroids(spark, d), 3, ["slide", "n"])


@query(f"with {fx.ASSIGNED}, e as (select slide, n, list_transform(dist, lambda v: exp(d1 - v)) as e from assigned) select slide, n, {_sql_text('list_transform(e, lambda v: v / list_sum(e))')} as p from e")
def softmax_distances(spark: SparkSession, d: str) -> DataFrame:
    return fx.assigned(spark, d).select("slide", "n", _text(softmax(F.transform("dist", lambda v: -v))).alias("p"))


@query(
    f"""with {fx.ASSIGNED}, t as (select a.slide, a.x, a.y, a.label from patch a), s as (select unnest([-1, 0, 1]) as i), w as (
      select a.slide, a.x, a.y, i.i, j.i as j, b.label from t a, s i, s j, t b where b.slide = a.slide and b.x = a.x + i.i and b.y = a.y + j.i)
    select slide, x, y, array_to_string(list(label::varchar order by i, j), ',') as around from w group by 1, 2, 3 having count(*) = 9"""
)
def neighbourhood_features(spark: SparkSession, d: str) -> DataFrame:
    found = smooth.neighbourhoods(fx.patches(spark, d), "label")
    return found.select("slide", "x", "y", F.array_join(F.transform("around", lambda v: v.cast("string")), ",").alias("around"))


@query(
    f"""with {fx.ASSIGNED}, f as (select slide, n, c1, label, list_distance(p.features, c.features) as d, c1 as k from (select a.*, p.features from assigned a join patch p using (slide, n)) p join (
      select k, list(m order by pos) as features from (select c1 as k, pos, avg(v) as m from (select a.c1, unnest(p.features) as v, generate_subscripts(p.features, 1) as pos from assigned a join patch p using (slide, n)) group by 1, 2) group by 1) c on c.k = p.c1),
    m as (select k, list(m order by pos) as features from (select c1 as k, pos, avg(v) as m from (select a.c1, unnest(p.features) as v, generate_subscripts(p.features, 1) as pos from assigned a join patch p using (slide, n)) group by 1, 2) group by 1),
    s as (select k, avg(d) as s from f group by 1)
    select round(avg(r), 6) as index from (select a.k, max((x.s + y.s) / list_distance(a.features, b.features)) as r from m a join m b on a.k <> b.k join s x on x.k = a.k join s y on y.k = b.k group by 1)"""
)
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return cluster.davies_bouldin(fx.assigned(spark, d), "c1").select(_round("index").alias("index"))


@query("select p_partkey from part where p_size % 2 = 1 and p_partkey % 2 = 1 and (p_size // 2) % 2 = 0 and (p_partkey // 2) % 2 = 1")
def binary_cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    bits = fx.read(spark, d, "part").selectExpr("p_partkey", "p_size % 2 as assigned", "p_partkey % 2 as b1", "(p_size div 2) % 2 as b2", "(p_partkey div 2) % 2 as b3")
    return cluster.binary_members(bits, 5, ["b1", "b2", "b3"]).select("p_partkey")


# Smoothing


@query(f"with {fx.GRID_TILES} select g.slide, g.x, g.y, (case when t.slide is null then 0 when positive = 0 then 1 else c1 + 2 end)::int as code from grid g left join tile t using (slide, x, y)")
def preview_codes_smoothing(spark: SparkSession, d: str) -> DataFrame:
    t = fx.grid_tiles(spark, d)
    return smooth.preview(t, fx.grid_cells(t))


@query(f"with {fx.GRID_TILES} select g.slide, g.x, g.y, (case when t.slide is null then 0 when c1 = 0 and c2 = 0 then 1 else c1 + 2 end)::int as code from grid g left join tile t using (slide, x, y)")
def preview_codes_render_compat(spark: SparkSession, d: str) -> DataFrame:
    t = fx.grid_tiles(spark, d)
    return smooth.preview(t, fx.grid_cells(t), render=True, compat=True)


_COLOURS = "colour(code, r, g, b) as (values " + ", ".join(f"({c}, {r}::double, {g}::double, {b}::double)" for c, r, g, b in smooth.colour_rows()) + ")"


@query(f"with {fx.GRID_TILES}, {_COLOURS}, p as (select g.slide, g.x, g.y, (case when t.slide is null then 0 when positive = 0 then 1 else c1 + 2 end)::int as code from grid g left join tile t using (slide, x, y)) select slide, x, y, p.code, r, g, b from p left join colour using (code)")
def preview_colours(spark: SparkSession, d: str) -> DataFrame:
    t = fx.grid_tiles(spark, d)
    return smooth.coloured(smooth.preview(t, fx.grid_cells(t))).select("slide", "x", "y", "code", "r", "g", "b")


@query(
    f"""with {fx.GRID_TILES}, p as (select g.slide, g.x, g.y, case when t.slide is null then 0 when positive = 0 then 1 else c1 + 2 end as code from grid g left join tile t using (slide, x, y)),
    s as (select unnest([-1, 0, 1]) as i), w as (select a.slide, a.x, a.y, a.code as mine, b.code from p a, s i, s j, p b where b.slide = a.slide and b.x = a.x + i.i and b.y = a.y + j.i and a.x between 1 and 18 and a.y between 1 and 18),
    lonely as (select slide, x, y, mine from w group by 1, 2, 3, 4 having mine <> 0 and count(*) filter (code = mine) = 1),
    counted as (select slide, x, y, code, count(*) as k from w semi join lonely using (slide, x, y) group by 1, 2, 3, 4),
    best as (select * from (select *, row_number() over (partition by slide, x, y order by k desc, code) as r from counted) where r = 1 and k >= 5)
    select t.slide, t.n, t.x, t.y, t.positive, (case when (b.code in (0, 1) and b.k >= 7) or b.code - 2 = t.c2 or b.code - 2 = t.c3 then b.code - 2 else t.c1 end)::int as c1, t.c2, t.c3
    from tile t left join best b using (slide, x, y)"""
)
def smoothing(spark: SparkSession, d: str) -> DataFrame:
    t = fx.grid_tiles(spark, d)
    return smooth.smoothed(t, fx.grid_cells(t)).select("slide", "n", "x", "y", "positive", "c1", "c2", "c3")


@query(
    f"""with {fx.GRID_TILES}, p as (select g.slide, g.x, g.y, case when t.slide is null then 0 when positive = 0 then 1 else c1 + 2 end as code from grid g left join tile t using (slide, x, y)),
    s as (select unnest([-1, 0, 1]) as i), w as (select a.slide, a.x, a.y, a.code as mine, b.code from p a, s i, s j, p b where b.slide = a.slide and b.x = a.x + i.i and b.y = a.y + j.i and a.x between 1 and 18 and a.y between 1 and 18),
    lonely as (select slide, x, y, mine from w group by 1, 2, 3, 4 having mine <> 0 and count(*) filter (code = mine) = 1),
    counted as (select slide, x, y, code, count(*) as k from w semi join lonely using (slide, x, y) group by 1, 2, 3, 4),
    best as (select * from (select *, row_number() over (partition by slide, x, y order by k desc, code) as r from counted) where r = 1 and k >= 5),
    after as (select t.c1 as was, case when (b.code in (0, 1) and b.k >= 7) or b.code - 2 = t.c2 or b.code - 2 = t.c3 then b.code - 2 else t.c1 end as c1 from tile t left join best b using (slide, x, y))
    select count(*) as tiles, count(*) filter (c1 <> was and c1 = -2) as to_background, count(*) filter (c1 <> was and c1 = -1) as to_negative, count(*) filter (c1 <> was and c1 >= 0) as to_cluster from after"""
)
def smoothing_changes(spark: SparkSession, d: str) -> DataFrame:
    t = fx.grid_tiles(spark, d)
    return smooth.changes(t, smooth.smoothed(t, fx.grid_cells(t)))


# Comparison


@query(f"with {fx.ASSIGNED}, k as (select unnest(range(0, (select max(c1) + 1 from assigned)))::int as cluster) select cluster, count(a.c1) as n from k left join assigned a on a.c1 = k.cluster group by 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return compare.cluster_sizes(fx.assigned(spark, d))


@query(f"with {fx.ASSIGNED} select slide, c1 as cluster, count(*) as n from assigned group by 1, 2")
def slide_cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.assigned(spark, d).groupBy("slide", F.col("c1").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = fx.RUNS + ", pair as (select a.slide, a.n, a.label as a, b.label as b from runs a join runs b using (slide, n) where a.run = 0 and b.run = 1)"
_OVERLAP = (
    _PAIRS
    + """, top as (select greatest(max(a), max(b)) as m from pair), k as (select unnest(range(0, (select m + 1 from top)))::int as v),
  cellc as (select x.v as a, y.v as b, count(p.n) as n from k x cross join k y left join pair p on p.a = x.v and p.b = y.v group by 1, 2),
  o as (select a, b, n, 100.0::double * n / nullif(sum(n) over (partition by a) + sum(n) over (partition by b) - n, 0) as of_union, 100.0::double * n / nullif(sum(n) over (partition by a), 0) as of_a,
    100.0::double * n / nullif(sum(n) over (partition by b), 0) as of_b from cellc)"""
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    runs = fx.run_labels(spark, d)
    return compare.aligned(runs.where("run = 0"), runs.where("run = 1"), ["slide", "n"])


@query(f"with {_OVERLAP} select a, b, n, round(of_union, 6) as of_union, round(of_a, 6) as of_a, round(of_b, 6) as of_b from o")
def cluster_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compare.overlap(_pairs(spark, d)).select("a", "b", "n", *(_round(c).alias(c) for c in ("of_union", "of_a", "of_b")))


@query(f"with {_OVERLAP} select a as cluster, b as match, round(of_union, 6) as percent from (select *, row_number() over (partition by a order by of_union desc nulls last, b) as r from o) where r = 1")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    return compare.best_matches(compare.overlap(_pairs(spark, d))).select("cluster", "match", _round("percent").alias("percent"))


_ARI = """, c as (select i, j, a, b, count(*)::double as n from pair group by 1, 2, 3, 4),
    pa as (select i, j, sum(m * (m - 1) / 2) as p from (select i, j, a, sum(n) as m from c group by 1, 2, 3) group by 1, 2), pb as (select i, j, sum(m * (m - 1) / 2) as p from (select i, j, b, sum(n) as m from c group by 1, 2, 3) group by 1, 2),
    pn as (select i, j, sum(n * (n - 1) / 2) as p, sum(n) as t from c group by 1, 2),
    ari as (select i, j, (pn.p - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)) as ari from pn join pa using (i, j) join pb using (i, j))"""


@query(f"with {fx.RUNS}, pair as (select 0 as i, 1 as j, a.label as a, b.label as b from runs a join runs b using (slide, n) where a.run = 0 and b.run = 1){_ARI} select round(ari, 6) as ari from ari")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return compare.rand_index(_pairs(spark, d)).select(_round("ari").alias("ari"))


@query(f"with {fx.RUNS}, pair as (select a.run as i, b.run as j, a.label as a, b.label as b from runs a join runs b using (slide, n) where a.run < b.run){_ARI} select round(avg(ari), 6) as mean_ari, round(stddev_samp(ari), 6) as sd_ari, count(*) as pairs from ari")
def pairwise_stability(spark: SparkSession, d: str) -> DataFrame:
    return compare.stability(fx.run_labels(spark, d), ["slide", "n"]).select(_round("mean_ari").alias("mean_ari"), _round("sd_ari").alias("sd_ari"), "pairs")


# Vectors and samples

_UNITS = (
    fx.PATCHES
    + """, u as (select slide, n, vec_id, label, list_transform(features, lambda v: v / sqrt(list_dot_product(features, features))) as f from patch),
  fl as (select label, unnest(f) as v, generate_subscripts(f, 1) as pos from u), cm as (select label, list(m order by pos) as c from (select label, pos, avg(v) as m from fl group by 1, 2) group by 1)"""
)


@query(f"with {_UNITS} select label, round(avg(1 - list_dot_product(f, c)), 6) as intra from u join cm using (label) group by 1")
def cosine_intra(spark: SparkSession, d: str) -> DataFrame:
    return samples.intra_class(fx.patches(spark, d)).select("label", _round("intra").alias("intra"))


@query(f"with {_UNITS} select a.label as a, b.label as b, round(1 - list_dot_product(a.c, b.c), 6) as inter from cm a join cm b on a.label < b.label")
def cosine_inter(spark: SparkSession, d: str) -> DataFrame:
    return samples.inter_class(fx.patches(spark, d)).select("a", "b", _round("inter").alias("inter"))


@query(
    f"with {_UNITS} select label::varchar as a, label::varchar as b, round(avg(1 - list_dot_product(f, c)), 6) as distance from u join cm using (label) group by 1 union all select least(a.label::varchar, b.label::varchar), greatest(a.label::varchar, b.label::varchar), round(1 - list_dot_product(a.c, b.c), 6) from cm a join cm b on a.label < b.label"
)
def monitored_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Distances within and between classes from the state after three batches."""
    p = fx.patches(spark, d)
    return monitor.cosines(monitor.over([p.where(F.col("vec_id") % 3 == b) for b in range(3)])).select("a", "b", _round("distance").alias("distance"))


@query(
    f"""with {fx.CENTROIDS}, near as (select c.id as centroid, p.vec_id, row_number() over (partition by c.id order by list_distance(p.features, c.features), p.vec_id) as r from patch p, centroid c),
    u as (select vec_id, list_transform(features, lambda v: v / sqrt(list_dot_product(features, features))) as f from patch),
    s as (select u.vec_id, k.centroid, list_dot_product(u.f, v.f) as s from u, near k join u v on v.vec_id = k.vec_id where k.r = 1)
    select vec_id, centroid as label from (select *, row_number() over (partition by vec_id order by s desc, centroid) as r from s) where r = 1 and s > 0.75"""
)
def reliable_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples.reliable(fx.patches(spark, d), fx.centroids(spark, d), "vec_id")


_DRAWN = """c as (select c1, count(*) <= 32 as few from assigned group by 1), d as (select unnest(range(0, 32))::int as draw),
    drawn as (select c1 as cluster, slide, n, (row_number() over (partition by c1 order by slide, n) - 1)::int as draw from assigned join c using (c1) where few
      union all select c1, slide, n, draw from (select *, row_number() over (partition by c1, draw order by md5(concat_ws('-', slide, n, draw, '7')), slide, n) as r from assigned join c using (c1), d where not few) where r = 1)"""


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    return samples.with_replacement(fx.assigned(spark, d).select("slide", "n", "c1"), "c1", ["slide", "n"])


@query(f"with {fx.ASSIGNED}, {_DRAWN} select cluster, slide, n, draw from drawn")
def random_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d).select(F.col("c1").alias("cluster"), "slide", "n", "draw")


@query(f"with {fx.ASSIGNED}, {_DRAWN} select cluster, slide, n, draw // 8 as row, draw % 8 as col from drawn")
def contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    return samples.contact_sheet(_drawn(spark, d), 8).select(F.col("c1").alias("cluster"), "slide", "n", "row", "col")


@query("select o_orderkey from orders order by md5(concat_ws('-', o_orderkey, '7')), o_orderkey limit 100")
def capped_random(spark: SparkSession, d: str) -> DataFrame:
    return samples.capped_images(fx.read(spark, d, "orders").select("o_orderkey"), 100, ["o_orderkey"])


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by md5(concat_ws('-', o_orderkey, '7')), o_orderkey) as r from orders) where r <= 2")
def random_of_each(spark: SparkSession, d: str) -> DataFrame:
    return samples.random_of_each(fx.read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 2)


@query("with s as (select s_suppkey, row_number() over (order by md5(concat_ws('-', s_suppkey, '7')), s_suppkey) - 1 as i, count(*) over () as n from supplier), p as (select unnest(range(0, 7 * 16)) as q) select (q // 16)::int as batch, (q % 16)::int as place, s_suppkey from p join s on s.i = p.q % s.n")
def cyclic_batches(spark: SparkSession, d: str) -> DataFrame:
    return samples.cyclic(fx.read(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 16, 7).select("batch", "place", "s_suppkey")


@query("select p_brand as class, count(*) as n, (select count(distinct p_brand) from part) >= 2 and (select max(c) from (select count(*) as c from part group by p_brand)) >= 50 as fit from part group by 1")
def class_guards(spark: SparkSession, d: str) -> DataFrame:
    return samples.class_sizes(fx.read(spark, d, "part").select(F.col("p_brand").alias("class")), 2, 50)


@query("select p_partkey as id, 200 + p_size as height, 224 as width, 3 as channels from part where p_size = 24")
def image_shape(spark: SparkSession, d: str) -> DataFrame:
    images = fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (200 + F.col("p_size")).cast("int").alias("height"), F.lit(224).alias("width"), F.lit(3).alias("channels"))
    return tiles.of_shape(images, 224, 224, 3)


@query("select distinct p_brand as name, (p_size % 5) / 10.0::double as r, (p_size % 7) / 10.0::double as g, 0.5::double as b from part")
def legend(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.read(spark, d, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 5 / F.lit(10.0)).alias("r"), (F.col("p_size") % 7 / F.lit(10.0)).alias("g"), F.lit(0.5).alias("b"))
    return smooth.legend(rows)


@query(f"with {fx.CENTROIDS}, u as (select id, list_transform(features, lambda v: v / sqrt(list_dot_product(features, features))) as f from centroid) select p.slide, p.n, {_sql_text('list(16 * list_dot_product(p.features, u.f) order by u.id)')} as out from patch p, u group by 1, 2")
def cosine_layer(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cosine_layer(fx.patches(spark, d), fx.centroids(spark, d), 16.0).select("slide", "n", _text("out").alias("out"))


# Graphs


@query(f"with {fx.GRID_TILES}, d as (select distinct slide, 3 * x + 1 as x from tile) select slide, min(g)::int as delta from (select slide, x - lag(x) over (partition by slide order by x) as g from d) group by 1")
def grid_spacing(spark: SparkSession, d: str) -> DataFrame:
    return graph.grid_spacing(fx.grid_tiles(spark, d).withColumn("x", 3 * F.col("x") + 1))


@query(f"with {fx.PATCHES} select a.slide, least(a.n, b.n) as a, greatest(a.n, b.n) as b, round(list_distance(a.features, b.features), 6) as w from patch a join patch b on a.slide = b.slide and a.n < b.n and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1")
def neighbour_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbour_edges(fx.patches(spark, d)).select("slide", "a", "b", _round("w").alias("w"))


_SEGMENTS = fx.PATCHES + """, fl as (select slide, label, unnest(features) as v, generate_subscripts(features, 1) as pos from patch),
  seg as (select slide, label as in_slide_id, (row_number() over (order by slide, label) - 1)::bigint as global_id, population, features from (
    select slide, label, max(c) as population, list(m order by pos) as features from (select slide, label, pos, avg(v) as m, count(*) as c from fl group by 1, 2, 3) group by 1, 2))"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return graph.segment_stack(fx.patches(spark, d))


@query(f"with {_SEGMENTS} select slide, in_slide_id, global_id, population, {_sql_text('features')} as features from seg")
def segment_stack(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("slide", "in_slide_id", F.col("global_id").cast("long").alias("global_id"), "population", _text("features").alias("features"))


@query(f"with {fx.PATCHES} select x as XPosition, y as YPosition, label as Label, slide, " + ", ".join(f"round(features[{k + 1}], 5) as xception_feature_{k}" for k in range(64)) + " from patch")
def segmentation_export(spark: SparkSession, d: str) -> DataFrame:
    made = writers.segmentation_table(fx.patches(spark, d), fx.patches(spark, d).select("slide", "n", "label"), 64, "xception")
    return made.select("XPosition", "YPosition", "Label", "slide", *(_round(f"xception_feature_{k}", 5).alias(f"xception_feature_{k}") for k in range(64)))


@query(f"with {fx.PATCHES} select slide as Slidename, x as XPosition, y as YPosition, " + ", ".join(f"round(features[{k + 1}], 5) as vgg16_feature_{k}" for k in range(64)) + " from patch")
def description_export(spark: SparkSession, d: str) -> DataFrame:
    made = writers.description_table(fx.patches(spark, d), 64, "vgg16")
    return made.select("Slidename", "XPosition", "YPosition", *(_round(f"vgg16_feature_{k}", 5).alias(f"vgg16_feature_{k}") for k in range(64)))


@query(
    f"""with recursive {fx.PATCHES}, e as (select a.slide, a.n as a, b.n as b from patch a join patch b on a.slide = b.slide and a.n <> b.n and a.label = b.label and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
    reach(slide, n, m) as (select slide, n, n from patch where (slide, n) in (select slide, a from e) union select reach.slide, reach.n, e.b from reach join e on e.slide = reach.slide and e.a = reach.m),
    c as (select slide, n, min(m) as root from reach group by 1, 2), k as (select slide, root, count(*) as size from c group by 1, 2)
    select slide, n, (row_number() over (partition by slide order by size desc, root) - 1) as label, size from (select * from k) join c using (slide, root) where false
    union all select c.slide, c.n, r.label, r.size from c join (select slide, root, size, row_number() over (partition by slide order by size desc, root) - 1 as label from k) r using (slide, root)"""
)
def components_by_size(spark: SparkSession, d: str) -> DataFrame:
    p = fx.patches(spark, d)
    same = graph.neighbour_edges(p).join(p.select("slide", F.col("n").alias("a"), F.col("label").alias("la")), ["slide", "a"]).join(p.select("slide", F.col("n").alias("b"), F.col("label").alias("lb")), ["slide", "b"]).where("la = lb")
    return graph.by_size(same.select("slide", "a", "b"))


_KNN = _SEGMENTS + """, near as (select a.global_id as i, b.global_id as j, list_distance(a.features, b.features) as w, row_number() over (partition by a.global_id order by list_distance(a.features, b.features), b.global_id) as r
  from seg a join seg b on a.global_id <> b.global_id), edge as (select least(i, j) as a, greatest(i, j) as b, min(w) as w from near where r <= 4 group by 1, 2)"""


def _knn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stack = _segments(spark, d).select(F.col("global_id").cast("long").alias("id"), "slide", "features")
    return written(stack, "stack"), written(graph.knn_edges(stack), "knn")


@query(f"with {_KNN} select a, b, round(w, 6) as w from edge")
def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d)[1].select("a", "b", _round("w").alias("w"))


#: The forest: edges whose ends lesser edges don't connect. The tree: a node for each of its edges, over what that edge and lesser ones connect.
_FOREST = _KNN + """, e as (select row_number() over (order by w, a, b) as r, a, b, w from edge), adj as (select r, a as u, b as v from e union all select r, b, a from e),
  reach(r, node) as (select r, a from e union select reach.r, adj.v from reach join adj on adj.u = reach.node and adj.r < reach.r),
  forest as (select * from e where not exists (select 1 from reach where reach.r = e.r and reach.node = e.b))"""
_TREE = _FOREST + """, fadj as (select r, a as u, b as v from forest union all select r, b, a from forest),
  upto(r, node) as (select r, a from forest union select upto.r, fadj.v from upto join fadj on fadj.u = upto.node and fadj.r <= upto.r),
  whole(a, b) as (select u, u from fadj union select whole.a, fadj.v from whole join fadj on fadj.u = whole.b), home as (select a as id, min(b) as tree from whole group by 1),
  ids as (select tree, id, row_number() over (partition by tree order by id) as k from home), nth as (select r, a, b, w, tree, row_number() over (partition by tree order by w, a, b) as k from forest join home on home.id = a),
  named as (select r, a, b, w, n.tree, i.id + 1 + (select max(global_id) from seg) as node from nth n join ids i on i.tree = n.tree and i.k = n.k),
  ends as (select r, 0 as side, a as leaf from named union all select r, 1, b from named),
  last as (select e.r, e.side, e.leaf, max(u.r) as q from ends e left join upto u on u.node = e.leaf and u.r < e.r group by 1, 2, 3),
  kid as (select l.r, l.side, coalesce(n.node, l.leaf) as node from last l left join named n on n.r = l.q),
  flatd as (select u.r, s.global_id as id, s.slide, unnest(s.features) as v, generate_subscripts(s.features, 1) as pos from upto u join seg s on s.global_id = u.node),
  means as (select r, list(m order by pos) as descriptor from (select r, pos, avg(v) as m from flatd group by 1, 2) group by 1),
  sets as (select u.r, count(*) as population, string_agg(distinct s.slide, ',' order by s.slide) as slides from upto u join seg s on s.global_id = u.node group by 1),
  raw as (select tree, node, (select node from kid where kid.r = named.r and side = 0) as l, (select node from kid where kid.r = named.r and side = 1) as rr, w, population, descriptor, slides from named join means using (r) join sets using (r)
    union all select tree, id, null, null, null, 1, s.features, s.slide from home join seg s on s.global_id = id),
  tree as (select raw.tree, raw.node, up.node as parent, raw.l, raw.rr as r, raw.w, raw.population, raw.descriptor, raw.slides from raw left join (select node, unnest([l, rr]) as child from raw where l is not null) up on up.child = raw.node)"""


@query(f"with recursive {_FOREST} select a, b, round(w, 6) as w from forest")
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.spanning_forest(_knn(spark, d)[1]).select("a", "b", _round("w").alias("w"))


@query(
    f"""with recursive {fx.PATCHES}, e as (select slide, a, b, w, row_number() over (partition by slide order by w, a, b) as i from (
      select a.slide, least(a.n, b.n) as a, greatest(a.n, b.n) as b, list_distance(a.features, b.features) as w from patch a join patch b on a.slide = b.slide and a.n < b.n and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1)),
    step(slide, i, comp, energy, used) as (select slide, 0::bigint, range(0, 100), list_transform(range(0, 100), lambda v: 0.0::double), list_transform(range(0, 100), lambda v: false) from (select distinct slide from e)
      union all select slide, i + 1, case when ok then list_transform(comp, lambda v: case when v = hi then lo else v end) else comp end, case when ok then list_transform(energy, lambda v, k: case when k = lo + 1 then w else v end) else energy end,
        case when ok then list_transform(used, lambda v, k: v or k = a + 1 or k = b + 1) else used end
      from (select *, least(ca, cb) as lo, greatest(ca, cb) as hi, ca <> cb and w <= least(energy[ca + 1] + 400.0::double / len(list_filter(comp, lambda v: v = ca)), energy[cb + 1] + 400.0::double / len(list_filter(comp, lambda v: v = cb))) as ok
        from (select s.*, e.a, e.b, e.w, s.comp[e.a + 1] as ca, s.comp[e.b + 1] as cb from step s join e on e.slide = s.slide and e.i = s.i + 1))),
    done as (select slide, arg_max(comp, i) as comp, arg_max(used, i) as used from step group by 1), flat as (select slide, unnest(comp) as root, unnest(used) as used, unnest(range(0, 100)) as n from done)
    select slide, n::bigint as n, (dense_rank() over (partition by slide order by root) - 1)::bigint as label from flat where used"""
)
def segments_felzenszwalb(spark: SparkSession, d: str) -> DataFrame:
    return graph.felzenszwalb(graph.neighbour_edges(fx.patches(spark, d)), coeff=400.0)


# Trees


def _tree(spark: SparkSession, d: str) -> DataFrame:
    stack, edges = _knn(spark, d)
    return written(trees.concept_tree(graph.spanning_forest(edges), stack), "tree")


@query(f"with recursive {_TREE} select tree, node, parent, l as left, r as right, round(w, 6) as weight, population, {_sql_text('descriptor')} as descriptor, slides from tree")
def concept_tree(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("tree", "node", "parent", "left", "right", _round("weight").alias("weight"), "population", _text("descriptor").alias("descriptor"), F.array_join("slides", ",").alias("slides"))


@query(
    f"""with recursive {_TREE}, kids as (select t.node, case when (x.population, x.node) < (y.population, y.node) then x.node else y.node end as small, case when (x.population, x.node) < (y.population, y.node) then y.node else x.node end as big,
      least(x.population, y.population) as pop from tree t join tree x on x.node = t.l join tree y on y.node = t.r),
    walk(start, cur, depth) as (select node, node, 0 from tree union all select start, big, depth + 1 from walk join kids on kids.node = walk.cur),
    best as (select * from (select start, small, big, row_number() over (partition by start order by pop desc, depth desc) as nth from walk join kids on kids.node = walk.cur) where nth = 1),
    sig(tree, node, parent) as (select tree, max(node), null::bigint from tree group by 1 union all select sig.tree, unnest([small, big]), sig.node from sig join best on best.start = sig.node)
    select sig.tree, sig.node, sig.parent, small as left, big as right, population from sig join tree using (node) left join best on best.start = sig.node"""
)
def significant_tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.significant_tree(_tree(spark, d))


@query(
    f"with recursive {_TREE} select t.node, t.population from tree t join tree a on a.node = t.l join tree b on b.node = t.r where t.population >= 3 and a.population < 3 and b.population < 3 union all select node, population from tree where l is null and population >= 3"
)
def truncated_leaves(spark: SparkSession, d: str) -> DataFrame:
    return trees.truncated_leaves(_tree(spark, d), 3)


_DOWN = "down(node, cur) as (select node, node from tree where l is not null union all select d.node, unnest([t.l, t.r]) from down d join tree t on t.node = d.cur where t.l is not null), under as (select d.node, d.cur as leaf from down d join tree t on t.node = d.cur where t.l is null)"


@query(f"with recursive {_TREE}, {_DOWN} select node, leaf from under")
def leaves_under(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return trees.leaves_under(t, t.where("left is not null").select("node"))


@query(
    f"""with recursive {_TREE}, v as (select node, l, r, descriptor as p, list_transform(descriptor, lambda x: 0.5::double * x + node) as q from tree),
    w as (select v.node, v.l, v.r, v.p, v.q, a.p as pl, b.p as pr, a.q as ql, b.q as qr from v left join v a on a.node = v.l left join v b on b.node = v.r),
    pairs(a, b, share) as (select max(node), max(node), 1.0::double from tree union all select unnest([x.l, x.r]), unnest(case when list_dot_product(x.pl, y.ql) + list_dot_product(x.pr, y.qr) >= list_dot_product(x.pl, y.qr) + list_dot_product(x.pr, y.ql)
      then [y.l, y.r] else [y.r, y.l] end), share / 2 from pairs join w x on x.node = a join w y on y.node = b where x.l is not null and y.l is not null)
    select round(sum(share * list_dot_product(x.p, y.q)), 4) as score from pairs join w x on x.node = a join w y on y.node = b where x.l is null or y.l is null"""
)
def tree_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    other = t.withColumn("descriptor", F.transform("descriptor", lambda x: 0.5 * x + F.col("node")))
    root = t.agg(F.max("node")).first()[0]
    return trees.similarity(t, other, root, root).select(_round("score", 4).alias("score"))


@query(
    f"""with recursive {_TREE}, {_DOWN}, q as (select node, floor(40 / count(*)) as quota from under group by 1),
    c as (select under.node, leaf, p.slide, p.x, p.y, row_number() over (partition by under.node, leaf order by md5(concat_ws('-', p.slide, p.x, p.y, '7')), p.slide, p.x, p.y) as r
      from under join seg on seg.global_id = under.leaf join patch p on p.slide = seg.slide and p.label = seg.in_slide_id)
    select node, leaf, slide, x, y from c join q using (node) where r <= quota"""
)
def concept_export_plan(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    stack = _segments(spark, d).select("slide", F.col("in_slide_id").alias("label"), F.col("global_id").cast("long").alias("global_id"))
    members = fx.patches(spark, d).join(stack, ["slide", "label"]).select("global_id", "slide", "x", "y")
    return samples.tree_export_plan(t, members, 40).select("node", "leaf", "slide", "x", "y")


# Consensus


_CONSENSUS = fx.RUNS + """, cr as (select case when run < 3 then 2 else 3 end as k, run, dense_rank() over (order by slide, n) as id, label from runs),
  m as (select a.k, a.id as i, b.id as j, avg((a.label = b.label)::int) as m from cr a join cr b on a.k = b.k and a.run = b.run and a.id < b.id group by 1, 2, 3)"""


def _consensus_runs(spark: SparkSession, d: str) -> DataFrame:
    r = fx.run_labels(spark, d)
    ids = tiles.numbered(r.select("slide", "n").distinct(), ["slide", "n"], "id")
    # Written, as consensus reads them more than once.
    return written(r.join(ids, ["slide", "n"]).select(F.when(F.col("run") < 3, 2).otherwise(3).alias("k"), "run", (F.col("id") + 1).cast("long").alias("id"), "label"), "consensus-runs")


@query(f"with {_CONSENSUS} select k, i, j, round(m, 6) as m from m where m > 0")
def consensus_matrix(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_matrix(_consensus_runs(spark, d), 6)


@query(
    f"""with {_CONSENSUS}, n as (select count(distinct id) as n from cr), e as (select k, m, 2 as t from m union all select distinct k, 1.0, n from m, n),
    r as (select k, min(m) as lo, max(m) as hi from e group by 1), b as (select e.k, least(floor((m - lo) / ((hi - lo) / 10))::int, 9) as bin, t from e join r using (k))
    select k, round(sum(t * (10 - bin)) / (n * n)::double, 6) as area from b, n group by k, n"""
)
def consensus_area(spark: SparkSession, d: str) -> DataFrame:
    runs = _consensus_runs(spark, d)
    return consensus.consensus_area(consensus.consensus_shares(runs), runs.select("id").distinct().count()).select("k", _round("area").alias("area"))


@query(
    """with a as (select (l_linenumber + 1)::int as k, sum(l_quantity) as area from lineitem group by 1),
    c as (select k, case when k > 2 then (lead(area) over (order by k) - area) / area else area end as change, lead(k) over (order by k) is null as final from a)
    select k, round(change, 6) as change, k = (select k from c where not final order by change desc, k limit 1) as best from c where not final"""
)
def best_k(spark: SparkSession, d: str) -> DataFrame:
    areas = fx.read(spark, d, "lineitem").groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(F.sum("l_quantity").alias("area"))
    return consensus.area_change(areas, 2).select("k", _round("change").alias("change"), "best")


@query(
    f"""with recursive {_CONSENSUS}, together as (select a.id as i, b.id as j from cr a join cr b on a.run = b.run and a.id < b.id group by 1, 2 having avg((a.label = b.label)::int) >= 0.8),
    e as (select i, j from together union select j, i from together), reach(id, r) as (select distinct id, id from cr union select reach.id, e.j from reach join e on e.i = reach.r)
    select id, min(r) as label from reach group by 1"""
)
def consensus_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return consensus.ensemble(_consensus_runs(spark, d), 0.8)


@query("with e as (select p_partkey, k, run from part, (select unnest([2, 3])::int as k) a, (select unnest([0, 1])::int as run) b), r as (select *, row_number() over (partition by k, run order by md5(concat_ws('-', p_partkey, k, run, '7')), p_partkey) as r from e) select k, run, p_partkey from r where r <= floor((select count(*) from part) * 0.75)")
def consensus_resample(spark: SparkSession, d: str) -> DataFrame:
    return consensus.resampled(fx.read(spark, d, "part").select("p_partkey"), "p_partkey", [2, 3], 2, 0.75)


@query(
    f"""with {fx.RUNS}, pair as (select a.run as i, b.run as j, a.label as a, b.label as b from runs a join runs b using (slide, n) where a.run < b.run and (a.run < 3) = (b.run < 3)){_ARI},
    s as (select case when i < 3 then 2 else 3 end as k, avg(ari) as mean_ari from ari group by 1) select k, round(mean_ari, 6) as mean_ari, k = (select k from s order by mean_ari desc, k limit 1) as best from s"""
)
def best_k_by_stability(spark: SparkSession, d: str) -> DataFrame:
    found = compare.stability(_consensus_runs(spark, d), ["id"], ["k"])
    return models.best_k(found).select("k", _round("mean_ari").alias("mean_ari"), "best")


# Fitted models


@query(f"with {fx.CENTROIDS} select p.slide, p.n, {_sql_text('list((list_dot_product(p.features, c.features) - 10 * c.id) / 100 order by c.id)')} as reduced from patch p, centroid c group by 1, 2")
def reduction_applied(spark: SparkSession, d: str) -> DataFrame:
    model = fx.centroids(spark, d).select(F.col("id").alias("component"), F.col("features").alias("weights"), (F.col("id") * 10.0).alias("shift"), F.lit(100.0).alias("scale"))
    return models.apply_reduction(fx.patches(spark, d), model).select("slide", "n", _text("reduced").alias("reduced"))


@query(
    f"""with {fx.PATCHES}, own as (select * from patch where positive = 1), fl as (select unnest(features) as v, generate_subscripts(features, 1) as pos from own), mean as (select list(m order by pos) as m from (select pos, avg(v) as m from fl group by 1)),
    c as (select slide, n, vec_id, list_transform(features, lambda v, j: v - m[j]) as f from own, mean), t as (select avg(list_dot_product(f, f)) as total from c)
    select slide, n, round(sqrt(list_dot_product(f, f)), 6) as length, round(list_dot_product(f, lag(f) over (order by vec_id)), 4) as product, round(total, 4) as total from c, t"""
)
def incremental_reduction(spark: SparkSession, d: str) -> DataFrame:
    """All components, batch by batch: lengths and products of projections are those of the rows from their mean, and the components' variances add up to the rows' own."""
    own = fx.patches(spark, d).where("positive = 1")
    state = None
    for b in range(3):
        state = reduction.partial_fit(state, own.where(F.expr("vec_id div 100 % 3") == b), 64)
    fitted = reduction.model(state)
    total = fitted.agg(F.sum(F.col("scale") * F.col("scale")).alias("total"))
    seen = models.apply_reduction(own, fitted.withColumn("scale", F.lit(1.0))).select("slide", "n", "vec_id", "reduced")
    seen = written(tiles.numbered(seen, ["vec_id"], "at"), "reduced")
    placed = seen.join(seen.select((F.col("at") + 1).alias("at"), F.col("reduced").alias("before")), "at", "left")
    return placed.crossJoin(F.broadcast(total)).select("slide", "n", _round(norm(F.col("reduced"))).alias("length"), _round(dot(F.col("reduced"), F.col("before")), 4).alias("product"), _round("total", 4).alias("total"))


@query()
def pca_scaled(spark: SparkSession, d: str) -> DataFrame:
    return models.reduced(fx.patches(spark, d).where("positive = 1")).select("slide", "n", F.size("reduced").alias("size"))


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return models.clustered(fx.patches(spark, d).where("positive = 1").drop("label"), 8)[0].select("slide", "n", "label")


@query()
def bisecting_clusters(spark: SparkSession, d: str) -> DataFrame:
    return models.clustered(fx.patches(spark, d).where("positive = 1").drop("label"), 8, bisecting=True)[0].select("slide", "n", "label")


#: Mini-batch k-means over eight batches of slides, from the first tile of each label below 8: a state a batch, as lists.
_MINI = fx.PATCHES + """, own as (select *, dense_rank() over (order by vec_id // 100 % 8) as b from patch where positive = 1), bat as (select b, list(features order by vec_id) as rows from own group by 1),
  mini(b, cs, ws) as (select 0::bigint, list(f order by label), list_transform(list(label), lambda v: 0.0::double) from (select label, arg_min(features, vec_id) as f from patch where label < 8 group by 1)
    union all select b, list_transform(cs, lambda c, i: case when len(g[i]) = 0 then c else list_transform(c, lambda v, j: (v * ws[i] + list_sum(list_transform(g[i], lambda r: r[j]))) / (ws[i] + len(g[i]))) end), list_transform(ws, lambda w, i: w + len(g[i]))
    from (select b, cs, ws, list_transform(ws, lambda w, i: list_filter(rows, lambda r, k: nearest[k] = i)) as g
      from (select bat.b, m.cs, m.ws, bat.rows, list_transform(bat.rows, lambda r: list_position(list_transform(m.cs, lambda c: list_distance(r, c)), list_min(list_transform(m.cs, lambda c: list_distance(r, c))))) as nearest from mini m join bat on bat.b = m.b + 1))),
  ids as (select list(distinct label order by label) as ids from patch where label < 8), state as (select cs, ws from mini order by b desc limit 1)"""


def _minibatch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = fx.patches(spark, d)
    first = p.where("label < 8").groupBy("label").agg(F.min_by("features", "vec_id").alias("features")).select(F.col("label").cast("long").alias("id"), "features", F.lit(0.0).alias("weight"))
    own = p.where("positive = 1").withColumn("batch", F.expr("vec_id div 100 % 8"))
    return own, minibatch.fit(own, written(first, "centres"), "batch")


@query(f"with recursive {_MINI} select unnest(ids)::bigint as id, unnest(ws) as weight, unnest(list_transform(cs, lambda c: {_sql_text('c')})) as features from state, ids")
def minibatch_centres(spark: SparkSession, d: str) -> DataFrame:
    return _minibatch(spark, d)[1].select("id", "weight", _text("features").alias("features"))


@query(f"with recursive {_MINI}, near as (select slide, n, list_transform(cs, lambda c: list_distance(features, c)) as far, ids from own, state, ids) select slide, n, ids[list_position(far, list_min(far))]::bigint as label, round(list_min(far), 6) as d from near")
def minibatch_clusters(spark: SparkSession, d: str) -> DataFrame:
    own, state = _minibatch(spark, d)
    return minibatch.predict(own, state).select("slide", "n", "label", _round("d").alias("d"))


@query(
    """with img as (select vec_id as id, list_transform(embedding, lambda v: floor((v::double + 1) * 127)::int) as px from embeddings),
    win as (select id, i, j, list_transform(range(0, 16), lambda k: px[(i + k // 4) * 8 + j + k % 4 + 1] / 127.5::double - 1) as w from img, (select unnest(range(0, 5)) as i) a, (select unnest(range(0, 5)) as j) b),
    word as (select id as word, list_transform(w, lambda v, k: v + 0.0131::double * id + 0.0071::double * k) as c from win where id < 6 and i = 0 and j = 0), d as (select win.id, i, j, list(list_distance(w, c) order by word) as far from win, word group by 1, 2, 3),
    n as (select id, list_position(far, list_min(far)) - 1 as word, count(*) as n from d group by 1, 2)
    select img.id, array_to_string(list(coalesce(n.n, 0)::varchar order by word.word), ',') as histogram from img cross join word left join n on n.id = img.id and n.word = word.word group by 1"""
)
def window_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of the nearest words of all windows of pictures of 8 x 8 pixels, each made of a vector."""
    shades = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127).cast("int"))
    images = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), shades.alias("pixels"))
    # The words are windows moved a little, so that none is as near to a window of whole numbers as another.
    corner = F.array(*(F.get("pixels", F.lit(8 * (k // 4) + k % 4)) / 127.5 - 1 + 0.0131 * F.col("id") + 0.0071 * (k + 1) for k in range(16)))
    words = images.where("id < 6").select(F.col("id").cast("int").alias("id"), corner.alias("features"))
    return models.features(images, "words", words=words, size=4).select("id", F.array_join("histogram", ",").alias("histogram"))


# Sinks


@query(f"with {fx.GRID_TILES} select slide, n as Patch_number, x as X, y as Y, positive as Positive, c1 as Cluster from tile")
def cluster_export(spark: SparkSession, d: str) -> DataFrame:
    return writers.cluster_table(fx.grid_tiles(spark, d))


@query(f"with {fx.PATCHES} select slide as Slidename, n as Number, x as X, y as Y, " + ", ".join(f"round(features[{k + 1}], 5) as feature_{k}" for k in range(64)) + " from patch")
def feature_export(spark: SparkSession, d: str) -> DataFrame:
    made = writers.feature_table(fx.patches(spark, d), 64)
    return made.select("Slidename", "Number", "X", "Y", *(_round(f"feature_{k}", 5).alias(f"feature_{k}") for k in range(64)))


@query(f"with {fx.GRID_TILES} select c1 as cluster, format('{{}}#{{}}-level16-{{}}-{{}}.jpg', slide, n, x, y) as path from tile where positive = 1 and c1 >= 0")
def cluster_manifest(spark: SparkSession, d: str) -> DataFrame:
    return writers.cluster_manifest(fx.grid_tiles(spark, d))
