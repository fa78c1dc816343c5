"""Selection, set operations, windows, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import select as Q
from ..operators import series as SE
from .bindings import BAND_PIXELS, PIXELS, SCENES, SITES, WIND, band_pixels, load, pixels, query, scenes, sites, wind

_G = "granule_id, tile, cloud_pct"


@query(f"WITH {SCENES} SELECT {_G} FROM scenes WHERE cloud_pct >= 10 AND cloud_pct < 30")
def f1_cloud_range(spark, sf):
    return Q.in_cloud_range(scenes(spark, sf), 0.1, 0.3).select("granule_id", "tile", "cloud_pct")


@query(f"WITH {SCENES} SELECT granule_id, acquired FROM scenes WHERE tile = 77 AND acquired BETWEEN '1996-01-01' AND '1999-12-31'")
def f2_tile_time_search(spark, sf):
    return Q.search(scenes(spark, sf), 77, "1996-01-01", "1999-12-31").select("granule_id", "acquired")


@query(f"WITH {BAND_PIXELS} SELECT chip_id, CAST(count(*) FILTER (scl IN (8, 9)) AS DOUBLE) / count(*) AS cloud FROM px GROUP BY 1 HAVING count(*) FILTER (scl IN (8, 9)) / count(*) >= 0.2 AND count(*) FILTER (scl IN (8, 9)) / count(*) < 0.6")
def f3_chip_cloud_fraction(spark, sf):
    shares = band_pixels(spark, sf).groupBy("chip_id").agg((F.count_if(F.col("scl").isin(8, 9)) / F.count("*")).alias("cloud"))
    return shares.where((F.col("cloud") >= 0.2) & (F.col("cloud") < 0.6))


@query(f"""WITH {BAND_PIXELS}, s AS (SELECT granule, count(*) FILTER (scl = 0) / count(*) AS nodata_share, coalesce(count(*) FILTER (scl <> 0 AND scl IN (3, 8, 9)) / nullif(count(*) FILTER (scl <> 0), 0), 1) AS bad_share FROM px GROUP BY 1)
SELECT granule, nodata_share, bad_share FROM s WHERE nodata_share < 0.09 AND bad_share < 0.28""")
def f4_granule_mask_filter(spark, sf):
    return Q.by_mask_shares(band_pixels(spark, sf), ["granule"], F.col("scl") == 0, F.col("scl").isin(3, 8, 9), 0.09, 0.28)


@query(f"WITH {BAND_PIXELS} SELECT chip_id, 100.0 * count(*) FILTER (scl = 0) / count(*) AS nodata FROM px GROUP BY 1 HAVING 100.0 * count(*) FILTER (scl = 0) / count(*) <= 5")
def f5_chip_nodata(spark, sf):
    return band_pixels(spark, sf).groupBy("chip_id").agg((100 * F.count_if(F.col("scl") == 0) / F.count("*")).alias("nodata")).where("nodata <= 5")


@query(f"WITH {BAND_PIXELS}, s AS (SELECT chip_id, 100.0 * count(*) FILTER (scl IN (8, 9)) / count(*) + 100.0 * count(*) FILTER (scl = 3) / count(*) + 100.0 * count(*) FILTER (scl = 0) / count(*) AS bad FROM px GROUP BY 1) SELECT chip_id, round(bad, 6) AS bad FROM s WHERE bad < 30")
def f6_bad_pixel_sum(spark, sf):
    share = lambda c: 100 * F.count_if(c) / F.count("*")
    sums = band_pixels(spark, sf).groupBy("chip_id").agg((share(F.col("scl").isin(8, 9)) + share(F.col("scl") == 3) + share(F.col("scl") == 0)).alias("bad"))
    return sums.where("bad < 30").withColumn("bad", F.round("bad", 6))


@query(f"WITH {SCENES} SELECT granule_id, acquired FROM scenes WHERE acquired NOT IN (SELECT o_orderdate FROM orders WHERE o_totalprice > 450000)")
def f7_exclude_dates(spark, sf):
    s = scenes(spark, sf)
    return Q.without_listed(s, s.where("cloud_pct > 90"), ["acquired"]).select("granule_id", "acquired")


@query(f"WITH {SCENES} SELECT granule_id, acquired FROM scenes WHERE floor(abs(epoch(acquired) - epoch(TIMESTAMP '1998-03-01 06:00:00')) / 86400) BETWEEN 1 AND 20")
def f8_near_days(spark, sf):
    return Q.near_in_time(scenes(spark, sf), "acquired", F.lit("1998-03-01 06:00:00").cast("timestamp"), 20).select("granule_id", "acquired")


@query(f"WITH {SCENES} SELECT granule_id, acquired FROM scenes WHERE floor((epoch(TIMESTAMP '1998-03-01 06:00:00') - epoch(acquired)) / 86400) BETWEEN 1 AND 20")
def f9_days_before(spark, sf):
    return Q.near_in_time(scenes(spark, sf), "acquired", F.lit("1998-03-01 06:00:00").cast("timestamp"), 20, before_only=True).select("granule_id", "acquired")


@query(f"WITH {SITES} SELECT site_id, q FROM sites WHERE region = 3 AND starts_with(site, 'Customer#0000001') AND q > 0")
def f10_ground_truth(spark, sf):
    return sites(spark, sf).where((F.col("region") == 3) & F.col("site").startswith("Customer#0000001") & (F.col("q") > 0)).select("site_id", "q")


@query(f"WITH {SCENES} SELECT granule_id FROM scenes WHERE cloud_pct < 20 AND nodata_pct < 2")
def f11_threshold_subset(spark, sf):
    return scenes(spark, sf).where("cloud_pct < 20 AND nodata_pct < 2").select("granule_id")


_BOX = "b AS (SELECT chip_id, min(row) AS r0, min(col) AS c0, max(row) + 1 AS r1, max(col) + 1 AS c1 FROM pixels WHERE v > 0.25 GROUP BY 1)"


def _boxes(spark, sf):
    return pixels(spark, sf).where("v > 0.25").groupBy("chip_id").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"))


@query(f"WITH {PIXELS}, {_BOX} SELECT chip_id, (r0 <= 5 AND r1 >= 3 AND c0 <= 5 AND c1 >= 3) AS touches FROM b")
def f12_touches_centre(spark, sf):
    return _boxes(spark, sf).select("chip_id", Q.touches_centre(*[F.col(c) for c in ("r0", "c0", "r1", "c1")], 8, 1).alias("touches"))


@query(f"WITH {PIXELS}, {_BOX} SELECT chip_id, (r0 < 6 AND r1 > 2 AND c0 < 6 AND c1 > 2) AS overlaps FROM b")
def f13_overlaps_centre(spark, sf):
    return _boxes(spark, sf).select("chip_id", Q.overlaps_centre(*[F.col(c) for c in ("r0", "c0", "r1", "c1")], 8, 2).alias("overlaps"))


@query(f"WITH {SITES} SELECT site_id FROM sites WHERE y BETWEEN 20 AND 60 AND NOT (x > 90 OR x < -5)")
def f15_latitude_band(spark, sf):
    return sites(spark, sf).where(F.col("y").between(20, 60) & ~((F.col("x") > 90) | (F.col("x") < -5))).select("site_id")


@query(f"WITH {BAND_PIXELS} SELECT CAST(count(*) FILTER (NOT (scl BETWEEN 0 AND 10)) AS BIGINT) AS class_range, CAST(count(*) FILTER (NOT (swir22 <= swir16)) AS BIGINT) AS ordered, CAST(count(*) FILTER (NOT (px BETWEEN 0 AND 90)) AS BIGINT) AS angle FROM px")
def f16_range_checks(spark, sf):
    return Q.violations(band_pixels(spark, sf), {"class_range": F.col("scl").between(0, 10), "ordered": F.col("swir22") <= F.col("swir16"), "angle": F.col("px").between(0, 90)})


@query(f"WITH {BAND_PIXELS} SELECT chip_id, px, swir16 / scl AS ratio FROM px WHERE scl <> 0")
def f17_drop_missing_key(spark, sf):
    rows = band_pixels(spark, sf).withColumn("ratio", F.try_divide("swir16", F.col("scl").cast("double")))
    return rows.where(F.col("ratio").isNotNull() & ~F.isnan("ratio")).select("chip_id", "px", "ratio")


@query(f"WITH {WIND} SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM wind WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 <> 0")
def f18_drop_empty(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return wind(spark, sf).select("event_id", F.when(k % 5 != 0, k).alias("k")).dropna(subset=["k"])


# -- windows ---------------------------------------------------------------------------------
_REFS = f"""{SCENES}, n AS (SELECT m.granule_id AS main, r.granule_id AS ref, row_number() OVER (PARTITION BY m.granule_id ORDER BY r.acquired DESC, r.granule_id) AS k
FROM scenes m JOIN scenes r ON m.tile = r.tile AND r.acquired < m.acquired AND epoch(m.acquired) - epoch(r.acquired) <= 720 * 86400 AND r.cloud_pct < 30)"""


@query(f"WITH {_REFS} SELECT main, max(ref) FILTER (k = 1) AS before, max(ref) FILTER (k = 2) AS earlier FROM n GROUP BY 1 HAVING count(*) FILTER (k = 2) > 0")
def w1_two_references(spark, sf):
    return Q.reference_pairs(scenes(spark, sf), F.col("cloud_pct") < 30, days=720)


@query(f"""WITH {SCENES}, r AS (SELECT tile, granule_id, row_number() OVER w AS rank, coalesce(count(*) FILTER (cloud_pct < 20) OVER (PARTITION BY tile ORDER BY acquired DESC, granule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM scenes WINDOW w AS (PARTITION BY tile ORDER BY acquired DESC, granule_id))
SELECT tile, granule_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8 AND c < 3""")
def w2_bounded_references(spark, sf):
    return Q.bounded_references(scenes(spark, sf), ["tile"], [F.col("acquired").desc(), F.col("granule_id")], F.col("cloud_pct") < 20, 8, 3).select("tile", "granule_id", "rank")


@query(f"WITH {WIND}, g AS (SELECT station, epoch_us(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) / 1e6 AS gap FROM wind) SELECT station, round(max(gap), 6) AS largest, coalesce(max(gap) <= 36000, TRUE) AS valid FROM g GROUP BY 1")
def w3_largest_gap(spark, sf):
    found = SE.spans(wind(spark, sf), ["station"], "ts", "event_id")
    return found.select("station", F.round("largest", 6).alias("largest"), F.coalesce(F.col("largest") <= 36000, F.lit(True)).alias("valid"))


@query(f"WITH {WIND}, d AS (SELECT event_id, station, ts, u * coalesce(epoch_us(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) / 1e6, 0) AS step FROM wind) SELECT event_id, round(sum(step) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS x FROM d")
def w4_cumulative_position(spark, sf):
    return SE.cumulative_position(wind(spark, sf), ["station"], "ts", "event_id", "u", "x").select("event_id", F.round("x", 3).alias("x"))


@query(f"""WITH {PIXELS}, c AS (SELECT chip_id, (row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5) AS d, row, col, greatest(v, 0) AS m FROM pixels), r AS (SELECT *, sum(m) OVER (PARTITION BY chip_id ORDER BY d, row, col ROWS UNBOUNDED PRECEDING) / sqrt(d) AS rate FROM c)
SELECT chip_id, round(max(rate), 6) AS best FROM r WHERE sqrt(d) BETWEEN 1 AND 4 GROUP BY 1""")
def w5_mass_by_distance(spark, sf):
    d = F.pow(F.col("row") - 3.5, 2) + F.pow(F.col("col") - 3.5, 2)
    rows = pixels(spark, sf).select("chip_id", "row", "col", d.alias("d"), F.greatest("v", F.lit(0.0)).alias("m"))
    order = Window.partitionBy("chip_id").orderBy("d", "row", "col").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rate", F.sum("m").over(order) / F.sqrt("d")).where(F.sqrt("d").between(1, 4)).groupBy("chip_id").agg(F.round(F.max("rate"), 6).alias("best"))


def _cross(q: float) -> str:
    return f"coalesce(max(CASE WHEN share >= {q} AND before < {q} THEN col - 1 + ({q} - before) / (share - before) END), 0)"


@query(f"""WITH {PIXELS}, s AS (SELECT chip_id, row, col, avg(abs(v)) OVER (PARTITION BY chip_id, row ORDER BY col ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM pixels), c AS (SELECT *, round(sum(a) OVER (PARTITION BY chip_id, row ORDER BY col ROWS UNBOUNDED PRECEDING) / sum(a) OVER (PARTITION BY chip_id, row), 12) AS share FROM s),
b AS (SELECT *, lag(share) OVER (PARTITION BY chip_id, row ORDER BY col) AS before FROM c) SELECT chip_id, row, round({_cross(0.9)} - {_cross(0.1)}, 6) AS width FROM b GROUP BY ALL""")
def w6_percentile_width(spark, sf):
    rows = pixels(spark, sf).withColumn("a", F.abs("v"))
    return Q.share_width(rows, ["chip_id", "row"], "col", "a", 4, 0.1, 0.9).withColumn("width", F.round("width", 6))


@query(f"WITH {SCENES}, n AS (SELECT granule_id, row_number() OVER (PARTITION BY tile ORDER BY acquired, granule_id) AS k, count(*) OVER (PARTITION BY tile) AS n FROM scenes) SELECT granule_id, CAST(2016 + floor((k - 1) * 10 / n) AS INTEGER) AS first_year, CAST(greatest(2016 + floor(k * 10 / n) - 1, 2016 + floor((k - 1) * 10 / n)) AS INTEGER) AS last_year FROM n")
def w7_year_bands(spark, sf):
    return Q.year_bands(scenes(spark, sf), ["tile"], ["acquired", "granule_id"], 2016, 10).select("granule_id", "first_year", "last_year")


@query(f"WITH {SCENES} SELECT granule_id, CAST(row_number() OVER (PARTITION BY sensor, tile ORDER BY sha256(CAST(granule_id AS VARCHAR)), granule_id) AS INTEGER) AS place FROM scenes")
def w8_dense_index(spark, sf):
    order = Window.partitionBy("sensor", "tile").orderBy(F.sha2(F.col("granule_id").cast("string"), 256), "granule_id")
    return scenes(spark, sf).select("granule_id", F.row_number().over(order).alias("place"))


@query("SELECT 1000 + row_number() OVER (ORDER BY n_nationkey) - 1 AS id, n_name FROM nation")
def w9_sequential_ids(spark, sf):
    # one row per nation: a bounded table
    return load(spark, sf, "nation").select((1000 + F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long").alias("id"), "n_name")


# -- top-k ---------------------------------------------------------------------------------
_CONF = "m AS (SELECT chip_id, count(*) FILTER (prob >= 0.6 AND abs(target) > 0.1) AS tp, count(*) FILTER (prob < 0.6 AND abs(target) > 0.1) AS fn FROM pixels GROUP BY 1)"


@query(f"WITH {PIXELS}, {_CONF} SELECT chip_id, round(tp / nullif(tp + fn, 0), 9) AS recall FROM m WHERE tp + fn > 0 ORDER BY 2, 1 LIMIT 20")
def k1_worst_chips(spark, sf):
    truth, found = F.abs("target") > 0.1, F.col("prob") >= 0.6
    recall = F.round(F.try_divide(F.count_if(found & truth), F.count_if(truth)), 9).alias("recall")
    return Q.worst_chips(pixels(spark, sf).groupBy("chip_id").agg(recall), "recall", "chip_id", 20)


@query(f"WITH {SITES}, r AS (SELECT region, site_id, round(sqrt(x * x + y * y), 9) AS d, row_number() OVER (PARTITION BY region ORDER BY round(sqrt(x * x + y * y), 9), site_id) AS rank FROM sites) SELECT region, site_id, d, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def k2_nearest_per_region(spark, sf):
    near = sites(spark, sf).select("region", "site_id", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 9).alias("d"))
    return Q.top_per_key(near, ["region"], [F.col("d"), F.col("site_id")], 5)


@query(f"WITH {SCENES} SELECT granule_id, tile, acquired FROM scenes ORDER BY acquired DESC, granule_id")
def k3_newest_first(spark, sf):
    return scenes(spark, sf).select("granule_id", "tile", "acquired").orderBy(F.col("acquired").desc(), "granule_id")


@query(f"WITH {PIXELS}, s AS (SELECT chip_id, round(max(prob), 9) AS best, round(sum(abs(prob * cond)), 6) AS total FROM pixels WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 GROUP BY 1) SELECT * FROM s ORDER BY best DESC, chip_id LIMIT 15")
def k4_top_pairs(spark, sf):
    centre = pixels(spark, sf).where(F.col("row").between(2, 5) & F.col("col").between(2, 5))
    sums = centre.groupBy("chip_id").agg(F.round(F.max("prob"), 9).alias("best"), F.round(F.sum(F.abs(S.marginal("prob", "cond"))), 6).alias("total"))
    return sums.orderBy(F.col("best").desc(), "chip_id").limit(15)


@query(f"WITH {PIXELS} SELECT chip_id, row, col FROM (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY v DESC, row, col) AS k FROM pixels) WHERE k = 1")
def k5_argmax_pixel(spark, sf):
    best = F.max_by(F.struct("row", "col"), F.struct("v", -F.col("row"), -F.col("col"))).alias("p")
    return pixels(spark, sf).groupBy("chip_id").agg(best).select("chip_id", "p.row", "p.col")


@query(f"WITH {SCENES} SELECT granule_id FROM scenes ORDER BY sha256(concat(CAST(granule_id AS VARCHAR), '-7')), granule_id LIMIT 100")
def k6_seeded_sample(spark, sf):
    return scenes(spark, sf).orderBy(F.sha2(F.concat(F.col("granule_id").cast("string"), F.lit("-7")), 256), "granule_id").limit(100).select("granule_id")


@query(f"WITH {SCENES} SELECT granule_id FROM scenes ORDER BY granule_id LIMIT 10")
def k7_first_k(spark, sf):
    return scenes(spark, sf).orderBy("granule_id").limit(10).select("granule_id")


# -- sets -----------------------------------------------------------------------------------
@query("SELECT o_orderkey AS k, o_orderstatus AS s, NULL::VARCHAR AS extra FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def u1_union_all(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {SCENES} SELECT tile, sensor, granule_id FROM (SELECT *, row_number() OVER (PARTITION BY tile, sensor ORDER BY acquired, granule_id) AS k FROM scenes) WHERE k = 1")
def u2_distinct_first(spark, sf):
    return Q.first_per_key(scenes(spark, sf), ["tile", "sensor"], [F.col("acquired"), F.col("granule_id")]).select("tile", "sensor", "granule_id")


@query("SELECT c_custkey AS tile FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def u3_key_difference(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("tile")).subtract(load(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query(f"WITH {SCENES}, i AS (SELECT granule_id, concat(sensor, '_', CAST(tile AS VARCHAR), '_', CAST(granule_id AS VARCHAR)) AS id FROM scenes) SELECT scene, id FROM (SELECT regexp_replace(id, '_[^_]*$', '') AS scene, id, row_number() OVER (PARTITION BY regexp_replace(id, '_[^_]*$', '') ORDER BY granule_id) AS k FROM i) WHERE k = 1")
def u4_same_scene(spark, sf):
    ids = scenes(spark, sf).select("granule_id", F.concat_ws("_", "sensor", F.col("tile").cast("string"), F.col("granule_id").cast("string")).alias("id"))
    return Q.first_per_key(ids.withColumn("scene", F.regexp_replace("id", "_[^_]*$", "")), ["scene"], [F.col("granule_id")]).select("scene", "id")


@query(f"WITH {SCENES} SELECT granule_id FROM (SELECT *, row_number() OVER (PARTITION BY sensor, tile, acquired, category ORDER BY (CASE WHEN granule_id % 3 = 0 THEN 'T2' ELSE 'T1' END = 'T1') DESC, acquired DESC, granule_id) AS k FROM scenes) WHERE k = 1")
def u5_best_granule(spark, sf):
    tiered = scenes(spark, sf).withColumn("tier", F.when(F.col("granule_id") % 3 == 0, "T2").otherwise("T1"))
    return Q.best_granules(tiered, ["sensor", "tile", "acquired", "category"], "tier", "acquired", "granule_id").select("granule_id")


@query(f"WITH {SITES}, a AS (SELECT region, count(*) AS train FROM sites WHERE q > 5000 GROUP BY 1), b AS (SELECT region + 1 AS region, count(*) AS val FROM sites WHERE q <= 5000 GROUP BY 1) SELECT coalesce(a.region, b.region) AS region, coalesce(train, -1) AS train, coalesce(val, -1) AS val FROM a FULL JOIN b ON a.region = b.region")
def u6_region_union(spark, sf):
    a = sites(spark, sf).where("q > 5000").groupBy("region").agg(F.count("*").alias("train"))
    b = sites(spark, sf).where("q <= 5000").groupBy((F.col("region") + 1).alias("region")).agg(F.count("*").alias("val"))
    return a.join(b, "region", "full").select("region", F.coalesce("train", F.lit(-1)).alias("train"), F.coalesce("val", F.lit(-1)).alias("val"))
