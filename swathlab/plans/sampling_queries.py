"""Sampling, splits, geometry, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import geo as G
from ..operators import nearest as NE
from ..operators import sampling as M
from ..operators import select as SL
from ..operators import series as SE
from .bindings import BAND_PIXELS, SCENES, SITES, WIND, band_pixels, load, query, scenes, sites, wind


def _u(*parts: str, seed: str = "") -> str:
    """The SQL of ``sampling.hashed``."""
    text = " || '|' || ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [f"'{seed}'"])
    return f"(CAST('0x' || right(sha256({text}), 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH {SCENES}, s AS (SELECT sensor, count(*) AS m, CASE sensor WHEN 'F' THEN 3000 WHEN 'O' THEN 9000 ELSE 10000 END AS quota FROM scenes GROUP BY 1), r AS (SELECT granule_id, scenes.sensor, row_number() OVER (PARTITION BY scenes.sensor ORDER BY {_u('granule_id', seed='s')}, granule_id) AS n, m, quota FROM scenes JOIN s ON scenes.sensor = s.sensor)
SELECT granule_id, sensor, CAST(quota // m + CAST(n <= quota % m AS INTEGER) AS BIGINT) AS copies FROM r WHERE quota // m + CAST(n <= quota % m AS INTEGER) > 0""")
def p2_stratified(spark, sf):
    wanted = spark.createDataFrame([("F", 3000), ("O", 9000), ("P", 10000)], "sensor string, quota long")
    return M.stratified(scenes(spark, sf), "sensor", "granule_id", wanted, "s").select("granule_id", "sensor", "copies")


@query(f"SELECT l_orderkey AS chip_id, l_linenumber AS n, l_extendedprice, CASE WHEN {_u('l_orderkey', 'l_linenumber')} < 0.7 THEN 'train' WHEN {_u('l_orderkey', 'l_linenumber')} < 0.9 THEN 'val' END AS side FROM lineitem")
def p3_train_val_split(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chip_id"), F.col("l_linenumber").alias("n"), "l_extendedprice")
    return M.split(rows, ["chip_id", "n"], {"train": 0.7, "val": 0.2})


@query(f"WITH {SCENES} SELECT granule_id, tile, CASE WHEN {_u('tile', seed='g')} < 0.5 THEN 'train' WHEN {_u('tile', seed='g')} < 1 THEN 'val' END AS side FROM scenes")
def p4_group_split(spark, sf):
    return M.split(scenes(spark, sf).select("granule_id", "tile"), ["tile"], {"train": 0.5, "val": 0.5}, seed="g")


def _gap(a: str, b: str) -> str:
    return f"(abs({a} - {b}) / 2 / (({a} + {b}) / 2 + 1e-6))"


def _split_sql(potency: float, weights: dict[str, float], seasons: bool) -> str:
    """SQL of ``split_scores`` over scenes: regions are categories, measures the cloud and missing shares."""
    return f"""WITH {SCENES}, s AS (SELECT *, CASE WHEN month(acquired) IN (12, 1, 2) THEN 1 WHEN month(acquired) < 6 THEN 2 WHEN month(acquired) < 9 THEN 3 ELSE 4 END AS season FROM scenes), x AS (SELECT s.*, k.range AS seed, {_u('tile', 'k.range')} < 0.5 AS l FROM s, range(40) k),
w AS (SELECT seed, count(*) FILTER (l) AS wa, count(*) FILTER (NOT l) AS wb FROM x GROUP BY 1), r AS (SELECT seed, category, count(*) FILTER (l) AS a, count(*) FILTER (NOT l) AS b, avg(cloud_pct) FILTER (l) AS ca, avg(cloud_pct) FILTER (NOT l) AS cb, avg(nodata_pct) FILTER (l) AS na, avg(nodata_pct) FILTER (NOT l) AS nb FROM x GROUP BY ALL),
e AS (SELECT seed, category, season, count(*) FILTER (l) AS a, count(*) FILTER (NOT l) AS b FROM x GROUP BY ALL), t AS (SELECT e.seed, e.category, sum(CASE WHEN e.a = 0 OR e.b = 0 THEN 10.0::DOUBLE * {potency} / n ELSE {_gap('e.a / r.a', 'e.b / r.b')} END) AS temporal FROM (SELECT *, count(*) OVER (PARTITION BY seed, category) AS n FROM e) e JOIN r ON r.seed = e.seed AND r.category = e.category WHERE r.a > 0 AND r.b > 0 GROUP BY ALL),
p AS (SELECT r.seed, sum(CASE WHEN a > 0 AND b > 0 THEN pow({_gap('a / wa', 'b / wb')}, {potency}) ELSE 1000 END) AS proportion, coalesce(sum({_gap('ca', 'cb')}) FILTER (a > 0 AND b > 0), 0) AS cloud, coalesce(sum({_gap('na', 'nb')}) FILTER (a > 0 AND b > 0), 0) AS nodata FROM r JOIN w USING (seed) GROUP BY 1),
c AS (SELECT p.seed, {weights['proportion']}::DOUBLE * proportion + {weights.get('temporal', 0) if seasons else 0}::DOUBLE * coalesce((SELECT sum(temporal) FROM t WHERE t.seed = p.seed), 0) + {weights['cloud_pct']}::DOUBLE * cloud + {weights['nodata_pct']}::DOUBLE * nodata AS score FROM p)
SELECT CAST(seed AS INTEGER) AS seed, round(score, 9) AS score FROM c ORDER BY 2, 1 LIMIT 1"""


_EVEN = {"proportion": 1.0, "cloud_pct": 2.0, "nodata_pct": 1.0}
_SEASONAL = {"proportion": 3.0, "temporal": 0.5, "cloud_pct": 2.0, "nodata_pct": 1.0}


@query(_split_sql(1.0, _EVEN, False))
def p5_best_split(spark, sf):
    return M.best_split(M.split_scores(scenes(spark, sf), "tile", "category", ["cloud_pct", "nodata_pct"], list(range(40)), 0.5, _EVEN)).select("seed", "score")


@query(_split_sql(2.0, _SEASONAL, True))
def p5_seasonal_split(spark, sf):
    rows = scenes(spark, sf).withColumn("season", S.season("acquired"))
    return M.best_split(M.split_scores(rows, "tile", "category", ["cloud_pct", "nodata_pct"], list(range(40)), 0.5, _SEASONAL, "season", 2.0)).select("seed", "score")


@query(None)
def p6_cluster_split(spark, sf):
    return M.cluster_split(sites(spark, sf), "site_id", ["x", "y"], 10, 5, 7, 10)


@query(f"WITH {SCENES} SELECT granule_id, CASE WHEN row_number() OVER (ORDER BY granule_id) <= floor((SELECT count(*) FROM scenes) * 0.8) THEN 'train' ELSE 'val' END AS side FROM scenes")
def p7_ordered_split(spark, sf):
    rows = scenes(spark, sf).select("granule_id")
    return M.ordered_split(rows, "granule_id", 0.8, F.floor(F.col("granule_id") / 4096))


@query(f"WITH {SITES}, c AS (SELECT region, count(*) AS n FROM sites GROUP BY 1) SELECT region, n / sum(n) OVER () AS share, CAST(round_even(n / sum(n) OVER () * 777, 0) AS BIGINT) AS quota FROM c".replace("n / sum(n) OVER () AS share", "round(n / sum(n) OVER (), 9) AS share"))
def p8_quotas(spark, sf):
    counts = sites(spark, sf).groupBy("region").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("region", (F.col("n") / F.col("total")).alias("share"))
    return M.quotas(shares, 777, "share").withColumn("share", F.round("share", 9))


@query(f"WITH {SCENES}, c AS (SELECT tile, count(*) AS n FROM scenes GROUP BY 1) SELECT tile, unnest(range(1, 12 - n + 1)) AS number FROM c WHERE n < 12")
def p9_top_up(spark, sf):
    return M.top_up(scenes(spark, sf), "tile", 12)


@query(f"WITH {SCENES} SELECT tile, granule_id FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {_u('granule_id', seed='p')}, granule_id) AS k FROM scenes WHERE year(acquired) <> 1996 AND cloud_pct <= 80) WHERE k = 1")
def p10_pick_existing(spark, sf):
    s = scenes(spark, sf)
    return M.pick_existing(s, "tile", "granule_id", s.where("cloud_pct > 80"), F.year("acquired") == 1996, "p").select("tile", "granule_id")


@query(f"WITH {SCENES}, r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {_u('granule_id', seed='p')}, granule_id) AS k FROM scenes), f AS (SELECT tile FROM r WHERE k = 1 AND {_u('granule_id', seed='x')} < (nodata_pct + (1 - nodata_pct / 100) * cloud_pct) / 100) SELECT tile, granule_id FROM r WHERE k = 1 OR (k = 2 AND tile IN (SELECT tile FROM f))")
def p11_extra_pick(spark, sf):
    s = scenes(spark, sf)
    first = M.pick_existing(s, "tile", "granule_id", s.where("false"), F.lit(False), "p", 2)
    chance = (F.col("nodata_pct") + (1 - F.col("nodata_pct") / 100) * F.col("cloud_pct")) / 100
    extra = first.where((F.col("rank") == 1) & (M.hashed("granule_id", seed="x") < chance)).select("tile")
    return first.where("rank = 1").unionByName(first.where("rank = 2").join(extra, "tile", "left_semi")).select("tile", "granule_id")


@query(f"SELECT l_orderkey AS chip_id, l_linenumber AS n, l_extendedprice, CASE WHEN {_u('l_orderkey', 'l_linenumber', seed='k')} < 0.5 THEN 0 WHEN {_u('l_orderkey', 'l_linenumber', seed='k')} < 0.8 THEN 1 WHEN {_u('l_orderkey', 'l_linenumber', seed='k')} < 0.95 THEN 2 ELSE 3 END AS plumes FROM lineitem")
def p12_number_of_plumes(spark, sf):
    u = M.hashed("l_orderkey", "l_linenumber", seed="k")
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chip_id"), F.col("l_linenumber").alias("n"), "l_extendedprice", M.number_by_table(u, [0.5, 0.8, 0.95, 1.0]).alias("plumes"))


@query(f"""WITH {SCENES}, o AS (SELECT granule_id, row_number() OVER (ORDER BY {_u('granule_id', seed='w')}, granule_id) - 1 AS place FROM scenes), n AS (SELECT count(*) AS n FROM scenes), d AS (SELECT unnest(range(n // 10)) AS draw, n FROM n)
SELECT draw, granule_id FROM d JOIN o ON place = CAST('0x' || right(sha256(CAST(draw AS VARCHAR) || 'w'), 8) AS BIGINT) % n""")
def p14_with_replacement(spark, sf):
    s = scenes(spark, sf)
    return M.with_replacement(s, "granule_id", s.count() // 10, "w")


@query("""SELECT c_custkey AS site_id, coalesce(CASE WHEN c_nationkey IN (3, 4) THEN 'listed' END, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 2 THEN 'two' END, 'other') AS area FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def p15_rule_cascade(spark, sf):
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    countries = spark.createDataFrame([(3, "listed"), (4, "listed")], "c_nationkey int, label string")
    continents = spark.createDataFrame([(0, "zero"), (2, "two")], "n_regionkey int, label string")
    return M.by_cascade(rows, [("c_nationkey", countries), ("n_regionkey", continents)], "area", "other").select(F.col("c_custkey").alias("site_id"), "area")


# -- geometry --------------------------------------------------------------------------------
# regions: one six-cornered ring per nation, from its key
_RING = """v AS (SELECT n_nationkey AS region, i, (n_nationkey % 5) * 20 + 10 + (5 + n_nationkey % 4) * cos(radians(60 * i + 10)) AS x, (n_nationkey // 5) * 20 + 10 + (5 + n_nationkey % 4) * sin(radians(60 * i + 10)) AS y FROM nation, (SELECT unnest(range(6)) AS i)),
e AS (SELECT region, i, x AS x0, y AS y0, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY region ORDER BY i)) AS x1, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY region ORDER BY i)) AS y1 FROM v WINDOW w AS (PARTITION BY region ORDER BY i))"""
_INSIDE = f"""{SITES}, {_RING}, ins AS (SELECT site_id, e.region FROM sites, e WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _vertices(spark, sf):
    k = F.col("n_nationkey")
    corners = load(spark, sf, "nation").withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(6)])))
    turn, radius = F.radians(60 * F.col("i") + 10), 5 + k % 4
    return corners.select(k.alias("region"), "i", ((k % 5) * 20 + 10 + radius * F.cos(turn)).alias("x"), (F.floor(k / 5) * 20 + 10 + radius * F.sin(turn)).alias("y"))


def _edges(spark, sf):
    return G.edges(_vertices(spark, sf), "region", "i", "x", "y")


@query(f"WITH {_INSIDE} SELECT s.site_id, min(ins.region) AS region FROM sites s LEFT JOIN ins ON s.site_id = ins.site_id GROUP BY 1")
def j16_centroid_in_region(spark, sf):
    points = sites(spark, sf).select("site_id", "x", "y")
    inside = G.in_regions(points, "site_id", "x", "y", _edges(spark, sf), "region", 5.0).groupBy("site_id").agg(F.min("region").alias("region"))
    return points.select("site_id").join(inside, "site_id", "left")


_TILES = "tl AS (SELECT s_suppkey AS tile, s_acctbal / 100 AS xmin, s_acctbal / 100 + 4 AS xmax, CAST(s_suppkey % 97 AS DOUBLE) AS ymin, CAST(s_suppkey % 97 AS DOUBLE) + 6 AS ymax FROM supplier)"
_BX = f"{_RING}, bx AS (SELECT region, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM v GROUP BY 1), {_TILES}"


def _tiles(spark, sf):
    x, y = F.col("s_acctbal") / 100, (F.col("s_suppkey") % 97).cast("double")
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile"), x.alias("xmin"), (x + 4).alias("xmax"), y.alias("ymin"), (y + 6).alias("ymax"))


@query(f"WITH {_BX} SELECT tile, EXISTS (SELECT 1 FROM bx WHERE tl.xmin <= bx.xmax AND bx.xmin <= tl.xmax AND tl.ymin <= bx.ymax AND bx.ymin <= tl.ymax) AS touches FROM tl")
def j17_intersects_any(spark, sf):
    tiles = _tiles(spark, sf)
    hits = G.box_matches(tiles, "tile", G.boxes(_edges(spark, sf), "region"), "region", 10.0).select("tile").distinct().withColumn("touches", F.lit(True))
    return tiles.select("tile").join(hits, "tile", "left").select("tile", F.coalesce("touches", F.lit(False)).alias("touches"))


def _clip_sql() -> str:
    """The overlap area by the crossings of a half-plane sum: exact for convex rings (here all are)."""
    def cut(src: str, dst: str, axis: str, bound: str, op: str) -> str:
        other = "y" if axis == "x" else "x"
        return f"""{dst} AS (SELECT tile, region, row_number() OVER (PARTITION BY tile, region ORDER BY k, s) AS k, x, y, {bound if False else 'x0, x1, y0, y1'} FROM (
SELECT tile, region, k, 0 AS s, x, y, x0, x1, y0, y1 FROM {src}n WHERE {axis} {op} {bound}
UNION ALL SELECT tile, region, k, 1, {f'{bound}, y + ({bound} - x) / (nx - x) * (ny - y)' if axis == 'x' else f'x + ({bound} - y) / (ny - y) * (nx - x), {bound}'}, x0, x1, y0, y1 FROM {src}n WHERE ({axis} {op} {bound}) <> (n{axis} {op} {bound}))),
{dst}n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY tile, region ORDER BY k)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY tile, region ORDER BY k)) AS ny FROM {dst} WINDOW w AS (PARTITION BY tile, region ORDER BY k))"""

    first = """c0 AS (SELECT tile, v.region, i AS k, x, y, tl.xmin AS x0, tl.xmax AS x1, tl.ymin AS y0, tl.ymax AS y1 FROM tl JOIN bx ON tl.xmin <= bx.xmax AND bx.xmin <= tl.xmax AND tl.ymin <= bx.ymax AND bx.ymin <= tl.ymax JOIN v ON v.region = bx.region),
c0n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY tile, region ORDER BY k)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY tile, region ORDER BY k)) AS ny FROM c0 WINDOW w AS (PARTITION BY tile, region ORDER BY k))"""
    cuts = [cut("c0", "c1", "x", "x0", ">="), cut("c1", "c2", "x", "x1", "<="), cut("c2", "c3", "y", "y0", ">="), cut("c3", "c4", "y", "y1", "<=")]
    area = "ar AS (SELECT tile, region, abs(sum(x * ny - nx * y)) / 2 AS area FROM c4n GROUP BY ALL)"
    return ", ".join([first, *cuts, area])


_AREAS = f"{_BX}, {_clip_sql()}"


def _overlaps(spark, sf):
    """tile, region, area of the overlap (only pairs whose boxes touch)."""
    ring = _vertices(spark, sf).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    ring = ring.select("region", F.transform("r", lambda p: p["x"]).alias("xs"), F.transform("r", lambda p: p["y"]).alias("ys"))
    tiles = _tiles(spark, sf)
    pairs = G.box_matches(tiles, "tile", G.boxes(_edges(spark, sf), "region"), "region", 10.0)
    return G.with_clip_area(pairs.join(tiles, "tile").join(ring, "region"), "xmin", "ymin", "xmax", "ymax", "xs", "ys", "area").select("tile", "region", "area")


@query(f"WITH {_AREAS} SELECT tile, region, round(area, 6) AS area FROM ar WHERE area > 1e-7")
def m20_clip_area(spark, sf):
    return _overlaps(spark, sf).where("area > 1e-7").withColumn("area", F.round("area", 6))


@query(f"WITH {_AREAS} SELECT tl.tile, coalesce(CAST(min(region) FILTER (area >= 2.4) AS VARCHAR), 'Other') AS region, coalesce(sum(area), 0) >= 2.4 AS enough FROM tl LEFT JOIN ar ON tl.tile = ar.tile GROUP BY 1")
def j18_overlap_share(spark, sf):
    areas = _overlaps(spark, sf).groupBy("tile").agg(F.min(F.when(F.col("area") >= 2.4, F.col("region"))).alias("r"), F.sum("area").alias("total"))
    joined = _tiles(spark, sf).select("tile").join(areas, "tile", "left")
    return joined.select("tile", F.coalesce(F.col("r").cast("string"), F.lit("Other")).alias("region"), (F.coalesce("total", F.lit(0.0)) >= 2.4).alias("enough"))


@query(f"WITH {_AREAS}, s AS (SELECT region, tile, round(sum(area), 6) AS area FROM ar GROUP BY ALL) SELECT region, tile, area FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY area DESC, tile) AS k FROM s) WHERE k = 1 AND area > 0")
def j19_best_tile(spark, sf):
    sums = _overlaps(spark, sf).groupBy("region", "tile").agg(F.round(F.sum("area"), 6).alias("area")).where("area > 0")
    return sums.groupBy("region").agg(F.max_by(F.struct("tile", "area"), F.struct("area", -F.col("tile"))).alias("b")).select("region", "b.tile", "b.area")


def _segment_sql(x: str, y: str) -> str:
    t = f"greatest(0, least(1, (({x} - x0) * (x1 - x0) + ({y} - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))))"
    return f"sqrt(pow({x} - (x0 + {t} * (x1 - x0)), 2) + pow({y} - (y0 + {t} * (y1 - y0)), 2))"


@query(f"WITH {SITES}, {_RING} SELECT site_id, round(min({_segment_sql('x', 'y')}), 6) AS distance FROM sites, e GROUP BY 1")
def j20_distance_to_area(spark, sf):
    found = NE.nearest_segment(sites(spark, sf), "site_id", "x", "y", _edges(spark, sf), "region")
    return found.select("site_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_INSIDE}, d AS (SELECT i.site_id, i.region, round(min({_segment_sql('x', 'y')}), 6) AS depth FROM ins i JOIN sites s USING (site_id) JOIN e ON e.region = i.region GROUP BY ALL) SELECT region, site_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY depth DESC, site_id) AS k FROM d) WHERE k = 1")
def j21_deepest_point(spark, sf):
    points, e = sites(spark, sf).select("site_id", "x", "y"), _edges(spark, sf)
    inside = G.in_regions(points, "site_id", "x", "y", e, "region", 5.0).join(points, "site_id")
    depths = NE.nearest_segment(inside, "site_id", "x", "y", e, "i", ["region"]).select("region", "site_id", F.round("distance", 6).alias("depth"))
    return depths.groupBy("region").agg(F.max_by(F.struct("site_id", "depth"), F.struct("depth", -F.col("site_id"))).alias("b")).select("region", "b.site_id", "b.depth")


@query(f"WITH {SITES} SELECT site_id, round((greatest(0, least(x + 5, 60) - greatest(x, 0)) * greatest(0, sin(radians(least(y / 2 + 10, 45))) - sin(radians(greatest(y / 2, 5))))) / ((60 - 0) * (sin(radians(45)) - sin(radians(5)))), 9) AS share FROM sites")
def m27_equal_area_share(spark, sf):
    x, y = F.col("x"), F.col("y") / 2
    share = G.equal_area_share(x, y, x + 5, y + 10, F.lit(0.0), F.lit(5.0), F.lit(60.0), F.lit(45.0))
    return sites(spark, sf).select("site_id", F.round(share, 9).alias("share"))


# -- reports ---------------------------------------------------------------------------------
_STATUS = "CASE WHEN scl = 0 THEN 'nodata' WHEN scl IN (8, 9) THEN 'no_reference' WHEN scl = 3 THEN 'no_overlap' ELSE 'success' END"


@query(f"WITH {BAND_PIXELS}, s AS (SELECT *, {_STATUS} AS status FROM px) SELECT granule, count(*) AS chips, round(100 * count(*) FILTER (status = 'success') / count(*), 6) AS success, round(100 * count(*) FILTER (status = 'nodata') / count(*), 6) AS nodata, round(100 * count(*) FILTER (status = 'no_overlap') / count(*), 6) AS no_overlap, round(avg(px) FILTER (status = 'success'), 6) AS mean_reference, round(stddev_pop(px) FILTER (status = 'success'), 6) AS std_reference, max(px) FILTER (status = 'success') AS max_reference FROM s GROUP BY 1")
def t38_chipping_report(spark, sf):
    status = F.when(F.col("scl") == 0, "nodata").when(F.col("scl").isin(8, 9), "no_reference").when(F.col("scl") == 3, "no_overlap").otherwise("success")
    rows = band_pixels(spark, sf).withColumn("status", status)
    share = lambda s: F.round(100 * F.count_if(F.col("status") == s) / F.count("*"), 6).alias(s)
    used = F.when(F.col("status") == "success", F.col("px"))
    return rows.groupBy("granule").agg(F.count("*").alias("chips"), share("success"), share("nodata"), share("no_overlap"), F.round(F.avg(used), 6).alias("mean_reference"), F.round(F.stddev_pop(used), 6).alias("std_reference"), F.max(used).alias("max_reference"))


@query(f"WITH {SCENES}, f AS (SELECT tile, min_by(category, granule_id) FILTER (category <> '5-LOW') AS region FROM scenes GROUP BY 1) SELECT granule_id, coalesce(f.region, category) AS region FROM scenes JOIN f USING (tile)")
def t39_region_override(spark, sf):
    s = scenes(spark, sf)
    first = s.groupBy("tile").agg(F.min_by("category", F.when(F.col("category") != "5-LOW", F.col("granule_id"))).alias("region"))
    return s.join(first, "tile").select("granule_id", F.coalesce("region", "category").alias("region"))


@query(f"WITH {SCENES} SELECT floor(cloud_pct / 10) * 10 AS cloud_min, floor(cloud_pct / 10) * 10 + 10 AS cloud_max, count(*) AS scenes, count(DISTINCT tile) AS tiles FROM scenes GROUP BY ALL")
def t40_scene_plan(spark, sf):
    low = F.floor(F.col("cloud_pct") / 10).cast("double") * 10
    return scenes(spark, sf).groupBy(low.alias("cloud_min"), (low + 10).alias("cloud_max")).agg(F.count("*").alias("scenes"), F.count_distinct("tile").alias("tiles"))


@query(f"WITH {SCENES} SELECT DISTINCT 0.0::DOUBLE AS cloud_min, 20.0::DOUBLE AS cloud_max, tile, CAST(acquired AS DATE) AS day FROM scenes")
def t40_distinct_queries(spark, sf):
    rows = scenes(spark, sf).withColumn("day", F.to_date("acquired"))
    return SL.scene_plan(rows, ["tile", "day"], 20.0)


@query(f"WITH {SCENES} SELECT floor(cloud_pct / 10) * 10 AS cloud_min, floor(cloud_pct / 10) * 10 + 10 AS cloud_max, tile, CAST(acquired AS DATE) AS day FROM scenes")
def t40_bucket_queries(spark, sf):
    low = F.floor(F.col("cloud_pct") / 10) * 10
    rows = scenes(spark, sf).withColumns({"day": F.to_date("acquired"), "low": low, "high": low + 10})
    return SL.scene_plan(rows, ["tile", "day"], 20.0, ("low", "high"))


_SERIES = f"{WIND}, g AS (SELECT *, epoch_us(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) / 1e6 AS gap FROM wind), ok AS (SELECT station, min(ts) AS t0, epoch_us(max(ts) - min(ts)) / 1e6 AS duration FROM g GROUP BY 1 HAVING max(gap) <= 120000)"


@query(f"WITH {_SERIES}, st AS (SELECT station, t0 + to_microseconds(CAST(floor({_u('station', seed='t')} * (duration - 86400)) AS BIGINT) * 1000000) AS start FROM ok WHERE duration >= 86400) SELECT w.event_id, w.station FROM wind w JOIN st USING (station) WHERE w.ts >= start AND w.ts < start + INTERVAL 1 DAY")
def t41_wind_window(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    series = SE.spans(wind(spark, sf), ["station"], "ts", "event_id").where("largest <= 120000 AND duration >= 86400")
    start = F.col("start") + F.floor(M.hashed("station", seed="t") * (F.col("duration") - 86400)) * 1000000
    windows = series.select("station", start.alias("start"))
    return wind(spark, sf).withColumn("t", t).join(windows, "station").where("t >= start AND t < start + 86400000000").select("event_id", "station")


@query(f"WITH {WIND} SELECT station, min_by(event_id, (ts, event_id)) AS first_event, min(ts) AS start, max(ts) AS finish, round(avg(sqrt(u * u + v * v)), 6) AS speed, round(avg(degrees(atan2(u, v))), 6) AS direction FROM wind GROUP BY 1")
def t42_series_metadata(spark, sf):
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return wind(spark, sf).groupBy("station").agg(first.alias("first_event"), F.min("ts").alias("start"), F.max("ts").alias("finish"), F.round(F.avg(S.wind_speed("u", "v")), 6).alias("speed"), F.round(F.avg(S.wind_direction("u", "v")), 6).alias("direction"))
