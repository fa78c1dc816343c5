"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import nearest as NE
from ..operators import rasters as RR
from ..operators import quantiles as QT
from ..operators import select as Q
from ..operators import series as SE
from .bindings import BAND_PIXELS, CHIPS, CURVE, PIXELS, SCENES, SITES, WIND, band_pixels, chips, curve, load, pixels, query, scenes, sites, wind


@query("""WITH m AS (SELECT round(median(p_retailprice), 1) AS m FROM part WHERE p_partkey % 3 <> 0), l AS (SELECT l_orderkey AS chip_id, l_linenumber AS n, l_partkey AS item, coalesce(p_retailprice, m) AS rate FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON l_partkey = p_partkey, m)
SELECT chip_id, array_to_string(list(printf('%.1f', rate) ORDER BY n, item), ' ') AS rates FROM l GROUP BY 1""")
def j1_rates_for_lists(spark, sf):
    items = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chip_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("items"))
    rates = load(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("rate"))
    found = J.rates_for_lists(items, ["chip_id"], "items", rates, "item", "rate")
    return found.select("chip_id", F.array_join(F.transform("rates", lambda r: F.format_string("%.1f", r)), " ").alias("rates"))


@query("SELECT o_orderkey AS granule_id, c_name AS tile_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j2_scene_tile(spark, sf):
    tiles = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = load(spark, sf, "orders").join(tiles, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("o_orderkey").alias("granule_id"), F.col("c_name").alias("tile_name"), "n_name")


@query("SELECT concat('siteid_', CAST(c_custkey AS VARCHAR), '-emitid_', CAST(o_orderkey AS VARCHAR)) AS dual_index, c_acctbal AS q FROM orders JOIN customer ON o_custkey = c_custkey")
def j3_site_granule(spark, sf):
    joined = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.concat(F.lit("siteid_"), "c_custkey", F.lit("-emitid_"), "o_orderkey").alias("dual_index"), F.col("c_acctbal").alias("q"))


@query("SELECT l_orderkey AS run_id, l_linenumber AS n, l_returnflag AS experiment, o_orderpriority AS note FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def j4_run_metrics(spark, sf):
    notes = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("note"))
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("experiment")).join(notes, "run_id", "left")


@query(f"WITH {SCENES} SELECT granule_id FROM scenes a WHERE NOT EXISTS (SELECT 1 FROM scenes b WHERE b.tile = a.tile AND b.sensor = a.sensor AND b.cloud_pct > 80)")
def j5_train_minus_validation(spark, sf):
    s = scenes(spark, sf)
    return Q.without_listed(s, s.where("cloud_pct > 80"), ["tile", "sensor"]).select("granule_id")


@query(f"WITH {SCENES} SELECT granule_id FROM scenes WHERE tile IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j6_listed_keys(spark, sf):
    listed = load(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("tile"))
    return Q.only_listed(scenes(spark, sf), listed, ["tile"]).select("granule_id")


@query(f"""WITH {WIND}, m AS (SELECT date_trunc('minute', ts) AS t, count(*) AS n, min(u) AS u FROM wind WHERE kind <> 'click' GROUP BY 1)
SELECT event_id, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN m.u END AS u FROM (SELECT event_id, ts FROM wind WHERE kind = 'click') w LEFT JOIN m ON date_trunc('minute', w.ts) = m.t""")
def j7_wind_of_minute(spark, sf):
    w = wind(spark, sf)
    return J.one_per_minute(w.where("kind = 'click'").select("event_id", "ts"), "ts", w.where("kind <> 'click'"), "ts", ["u"]).select("event_id", "matches", "u")


@query(f"WITH {WIND}, d AS (SELECT CAST(ts AS DATE) AS day, kind, round(avg(u), 6) AS mean_u FROM wind GROUP BY ALL) SELECT w.event_id, d.mean_u FROM wind w JOIN d ON CAST(w.ts AS DATE) = d.day AND w.kind = d.kind")
def j8_wind_by_date_sensor(spark, sf):
    w = wind(spark, sf).withColumn("day", F.col("ts").cast("date"))
    means = w.groupBy("day", "kind").agg(F.round(F.avg("u"), 6).alias("mean_u"))
    return w.join(means, ["day", "kind"]).select("event_id", "mean_u")


@query(f"WITH {SITES}, g AS (SELECT s_suppkey % 12 AS ix, s_suppkey // 12 AS iy, s_acctbal AS value FROM supplier) SELECT site_id, value FROM sites LEFT JOIN g ON CAST(round_even((x + 10) / 10, 0) AS BIGINT) = ix AND CAST(round_even(y / 10, 0) AS BIGINT) = iy")
def j9_nearest_grid_cell(spark, sf):
    grid = load(spark, sf, "supplier").select((F.col("s_suppkey") % 12).alias("ix"), F.floor(F.col("s_suppkey") / 12).alias("iy"), F.col("s_acctbal").alias("value"))
    return J.nearest_grid_cell(sites(spark, sf), grid, "x", "y", -10.0, 0.0, 10.0).select("site_id", "value")


_TARGETS = "t AS (SELECT s_suppkey AS target_id, s_acctbal / 100 AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y FROM supplier)"


@query(f"WITH {SITES}, {_TARGETS} SELECT site_id, target_id, round(d2, 6) AS d2 FROM (SELECT site_id, target_id, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) AS d2, row_number() OVER (PARTITION BY site_id ORDER BY (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y), target_id) AS k FROM sites s, t) WHERE k = 1")
def j10_nearest_point(spark, sf):
    targets = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("tid"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"))
    return NE.nearest_point(sites(spark, sf), "site_id", targets, "tid", "x", "y").withColumn("d2", F.round("d2", 6))


@query(f"WITH {SCENES} SELECT granule_id, (SELECT r.granule_id FROM scenes r WHERE r.tile = m.tile AND r.acquired < m.acquired AND r.cloud_pct < 30 ORDER BY r.acquired DESC, r.granule_id LIMIT 1) AS matched FROM scenes m")
def j11_as_of_reference(spark, sf):
    s = scenes(spark, sf)
    return SE.as_of(s.select("granule_id", "tile", "acquired"), s.where("cloud_pct < 30"), ["tile"], "acquired", "acquired", "granule_id").select("granule_id", "matched")


@query(f"WITH {SCENES} SELECT a.tile, a.granule_id AS first, b.granule_id AS second FROM scenes a JOIN scenes b ON a.tile = b.tile WHERE a.cloud_pct < 20 AND b.cloud_pct < 20")
def j12_ordered_pairs(spark, sf):
    return J.pairs_within(scenes(spark, sf).where("cloud_pct < 20"), ["tile"], "granule_id", ordered=True)


@query(f"WITH {SCENES} SELECT a.tile, a.granule_id AS first, b.granule_id AS second FROM scenes a JOIN scenes b ON a.tile = b.tile AND a.granule_id <= b.granule_id WHERE a.cloud_pct < 20 AND b.cloud_pct < 20")
def j13_unordered_pairs(spark, sf):
    return J.pairs_within(scenes(spark, sf).where("cloud_pct < 20"), ["tile"], "granule_id", ordered=False)


@query("SELECT r_name AS bucket, n_name AS query, t AS transformation FROM region, nation, (VALUES ('plain'), ('modulated')) v(t)")
def j14_job_grid(spark, sf):
    grid = load(spark, sf, "region").select(F.col("r_name").alias("bucket")).crossJoin(load(spark, sf, "nation").select(F.col("n_name").alias("query")))
    return J.with_each(grid, J.thresholds(spark, [("plain",), ("modulated",)], ["transformation"]))


@query(f"WITH {PIXELS}, t(marker, floor) AS (VALUES (0.8, 0.5), (0.7, 0.4), (0.6, 0.3)) SELECT region, marker, floor, count(*) FILTER (prob >= marker) AS strong, count(*) FILTER (prob >= floor) AS some FROM pixels, t GROUP BY ALL")
def j15_multi_threshold(spark, sf):
    return A.counts_by_thresholds(pixels(spark, sf), ["region"], {"marker": "strong", "floor": "some"}, F.col("prob"), [(0.8, 0.5), (0.7, 0.4), (0.6, 0.3)])


@query(f"WITH {CHIPS} SELECT a.chip_id, sum(x * y) AS dot FROM (SELECT chip_id, unnest(raster) AS x, generate_subscripts(raster, 1) AS i FROM chips) a JOIN (SELECT chip_id - 1 AS chip_id, unnest(raster) AS y, generate_subscripts(raster, 1) AS i FROM chips) b ON a.chip_id = b.chip_id AND a.i = b.i GROUP BY 1".replace("sum(x * y)", "round(sum(x * y), 6)"))
def j22_matching_pixels(spark, sf):
    c = chips(spark, sf)
    nxt = c.select((F.col("chip_id") - 1).alias("chip_id"), F.col("raster").alias("other"))
    products = F.zip_with("raster", "other", lambda a, b: a * b)
    return c.join(nxt, "chip_id").select("chip_id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 6).alias("dot"))


@query(f"WITH {PIXELS}, l AS (SELECT chip_id, row, col, CAST(row // 4 * 2 + col // 4 AS INTEGER) AS label FROM pixels WHERE prob >= 0.5) SELECT p.chip_id, l.label, count(*) AS n, round(sum(p.cond), 6) AS total FROM pixels p JOIN l ON p.chip_id = l.chip_id AND p.row = l.row AND p.col = l.col GROUP BY ALL")
def j23_pixels_labels(spark, sf):
    p = pixels(spark, sf)
    labels = p.where("prob >= 0.5").select("chip_id", "row", "col", (F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4)).cast("int").alias("label"))
    return p.join(labels, ["chip_id", "row", "col"]).groupBy("chip_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("cond"), 6).alias("total"))


@query(f"WITH {CURVE} SELECT wavelength, round(response * (response / 1000), 6) AS response FROM curve")
def j24_aligned_product(spark, sf):
    c = curve(spark, sf)
    return J.aligned_product(c, c.withColumn("response", F.col("response") / 1000), "wavelength", "response").withColumn("response", F.round("response", 6))


@query(f"""WITH {SCENES}, d AS (SELECT tile, acquired, min(granule_id) AS item FROM scenes GROUP BY ALL), m AS (SELECT granule_id, tile, acquired - INTERVAL 5 DAY AS before, acquired - INTERVAL 10 DAY AS earlier FROM scenes)
SELECT granule_id, b.item AS before_item, e.item AS earlier_item, (b.item IS NULL OR e.item IS NULL) AS missing FROM m LEFT JOIN d b ON m.tile = b.tile AND m.before = b.acquired LEFT JOIN d e ON m.tile = e.tile AND m.earlier = e.acquired""")
def j26_named_references(spark, sf):
    s = scenes(spark, sf)
    mains = s.select("granule_id", "tile", (F.col("acquired") - F.expr("INTERVAL 5 DAY")).alias("before"), (F.col("acquired") - F.expr("INTERVAL 10 DAY")).alias("earlier"))
    refs = s.groupBy("tile", "acquired").agg(F.min("granule_id").alias("item"))
    return J.named_references(mains, refs, ["tile"], "before", "earlier", "acquired", "item").select("granule_id", "before_item", "earlier_item", "missing")


# -- aggregates --------------------------------------------------------------------------
_PRED, _TRUE = "prob >= 0.6", "abs(target) > 0.1"
_COUNTS = f"count(*) FILTER ({_PRED} AND {_TRUE}) AS tp, count(*) FILTER (NOT {_PRED} AND NOT ({_TRUE})) AS tn, count(*) FILTER ({_PRED} AND NOT ({_TRUE})) AS fp, count(*) FILTER (NOT {_PRED} AND {_TRUE}) AS fn, count(*) FILTER ({_TRUE}) AS positives, count(*) FILTER (NOT ({_TRUE})) AS negatives"
_RATES = "fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr, tn / nullif(fp + tn, 0) AS tnr, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


def _pt():
    return F.col("prob") >= 0.6, F.abs("target") > 0.1


@query(f"WITH {PIXELS} SELECT region, {_COUNTS} FROM pixels GROUP BY 1")
def a1_confusion(spark, sf):
    return A.confusion(pixels(spark, sf), ["region"], *_pt())


@query(f"WITH {PIXELS}, c AS (SELECT chip_id, {_COUNTS} FROM pixels GROUP BY 1) SELECT *, {_RATES} FROM c")
def a2_rates(spark, sf):
    return A.rates(A.confusion(pixels(spark, sf), ["chip_id"], *_pt()))


@query(f"WITH c AS (SELECT quality AS label, count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS negatives FROM labels GROUP BY 1) SELECT *, {_RATES} FROM c")
def a2_label_rates(spark, sf):
    rows = load(spark, sf, "labels").withColumn("label", F.col("quality"))
    return A.rates(A.confusion(rows, ["label"], F.col("toxic") == 1, F.col("quality") == 1))


@query(f"WITH {PIXELS} SELECT region, round(sum((target - prob * cond) * (target - prob * cond)) / count(DISTINCT chip_id), 6) AS mse FROM pixels GROUP BY 1")
def a3_mse_per_sample(spark, sf):
    return A.mse_per_sample(pixels(spark, sf), ["region"], F.col("prob") * F.col("cond"), F.col("target"), "chip_id").withColumn("mse", F.round("mse", 6))


@query(f"WITH {PIXELS} SELECT region, round(avg(prob) FILTER ({_TRUE}) / nullif(stddev_pop(prob) FILTER (NOT ({_TRUE})), 0), 6) AS snr FROM pixels GROUP BY 1")
def a4_signal_to_noise(spark, sf):
    return A.signal_to_noise(pixels(spark, sf), ["region"], F.col("prob"), _pt()[1]).withColumn("snr", F.round("snr", 6))


@query(f"WITH {PIXELS} SELECT region, count(v) AS n, round(avg(v), 9) AS mean, round(var_pop(v), 9) AS var FROM pixels GROUP BY 1")
def a5_merge_states(spark, sf):
    parts = A.state(pixels(spark, sf), ["region", "chip_id"], F.col("v"))
    merged = A.merge_states(parts, ["region"])
    return merged.select("region", "n", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


_MAIN, _REF = "(scl <> 0)", "(px % 5 <> 0)"


@query(f"""WITH {BAND_PIXELS}, c AS (SELECT chip_id, count(*) FILTER ({_MAIN} AND {_REF}) AS bo, count(*) FILTER {_MAIN} AS main, count(*) FILTER ({_MAIN} AND {_REF} AND scl IN (8, 9)) AS cl, count(*) FILTER ({_MAIN} AND {_REF} AND scl = 3) AS sh, count(*) FILTER ({_MAIN} AND NOT {_REF}) AS nd FROM px GROUP BY 1)
SELECT chip_id, round(100 * bo / nullif(main, 0), 6) AS overlap, round(100 * cl / (bo + 0.01::DOUBLE), 6) AS cloud, round(100 * sh / (bo + 0.01::DOUBLE), 6) AS shadow, round(100 * nd / nullif(main, 0), 6) AS nodata FROM c""")
def a6_reference_quality(spark, sf):
    main, ref = F.col("scl") != 0, F.col("px") % 5 != 0
    found = A.reference_quality(band_pixels(spark, sf), ["chip_id"], main, ref, F.col("scl").isin(8, 9), F.col("scl") == 3, ~ref)
    return found.select("chip_id", *[F.round(c, 6).alias(c) for c in ("overlap", "cloud", "shadow", "nodata")])


@query("WITH " + BAND_PIXELS + " SELECT granule, round(100 * count(*) FILTER (scl = 0) / count(*), 6) AS nodata, " + ", ".join(f"round(100 * count(*) FILTER (scl = {c}) / (count(*) FILTER (scl <> 0) + 0.001::DOUBLE), 6) AS class_{c}" for c in (3, 8, 9)) + " FROM px GROUP BY 1")
def a7_tile_metadata(spark, sf):
    found = A.class_shares(band_pixels(spark, sf), ["granule"], "scl", [3, 8, 9], F.col("scl") != 0)
    return found.select("granule", *[F.round(c, 6).alias(c) for c in ("nodata", "class_3", "class_8", "class_9")])


@query("WITH " + BAND_PIXELS + " SELECT chip_id, " + ", ".join(f"round(100 * count(*) FILTER (scl = {c} AND px % 3 = {s}) / (count(*) FILTER (scl <> 0 AND px % 3 = 0) + 0.001::DOUBLE), 6) AS class_{c}_{s}" for c in (8, 9) for s in (0, 1, 2)) + " FROM px GROUP BY 1")
def a8_chip_metadata(spark, sf):
    valid = F.count_if((F.col("scl") != 0) & (F.col("px") % 3 == 0)) + 0.001
    shares = [F.round(100 * F.count_if((F.col("scl") == c) & (F.col("px") % 3 == s)) / valid, 6).alias(f"class_{c}_{s}") for c in (8, 9) for s in (0, 1, 2)]
    return band_pixels(spark, sf).groupBy("chip_id").agg(*shares)


@query(f"WITH {BAND_PIXELS} SELECT chip_id, round(coalesce(count(*) FILTER ({_MAIN} AND {_REF}) / nullif(count(*) FILTER {_MAIN}, 0), 0), 9) AS share FROM px GROUP BY 1")
def a9_overlap(spark, sf):
    main, ref = F.col("scl") != 0, F.col("px") % 5 != 0
    return band_pixels(spark, sf).groupBy("chip_id").agg(F.round(F.coalesce(F.try_divide(F.count_if(main & ref), F.count_if(main)), F.lit(0.0)), 9).alias("share"))


@query(f"WITH {PIXELS} SELECT region, count(*) AS pixels, count(DISTINCT chip_id) AS samples, count(*) FILTER ({_TRUE}) AS true_pixels FROM pixels GROUP BY 1")
def a10_pixel_counts(spark, sf):
    per = pixels(spark, sf).groupBy("region", "chip_id").agg(F.count("*").alias("n"), F.count_if(_pt()[1]).alias("t"))
    return per.groupBy("region").agg(F.sum("n").alias("pixels"), F.count("*").alias("samples"), F.sum("t").alias("true_pixels"))


@query(f"WITH {PIXELS}, l AS (SELECT region, chip_id, greatest(v, 0) - v * CAST({_TRUE} AS DOUBLE) + ln(1 + exp(-abs(v))) AS bce, CASE WHEN {_TRUE} THEN (cond - target) * (cond - target) ELSE 0 END AS mse FROM pixels) SELECT region, round(sum(bce) / count(DISTINCT chip_id), 6) AS bce, round(sum(mse) / count(DISTINCT chip_id), 6) AS mse, round(sum(bce + mse) / count(DISTINCT chip_id), 6) AS combined FROM l GROUP BY 1")
def a12_loss_totals(spark, sf):
    from ..functions.scalar import bce_with_logits

    truth = _pt()[1]
    per = pixels(spark, sf).groupBy("region", "chip_id").agg(F.sum(bce_with_logits("v", truth.cast("double"))).alias("b"), F.sum(F.when(truth, F.pow(F.col("cond") - F.col("target"), 2)).otherwise(0.0)).alias("m"))
    return per.groupBy("region").agg(F.round(F.sum("b") / F.count("*"), 6).alias("bce"), F.round(F.sum("m") / F.count("*"), 6).alias("mse"), F.round((F.sum("b") + F.sum("m")) / F.count("*"), 6).alias("combined"))


@query(f"WITH {PIXELS}, i AS (SELECT region, chip_id, avg((CASE WHEN {_TRUE} THEN 1 ELSE 0.25 END) * (v - target) * (v - target)) AS e FROM pixels GROUP BY ALL) SELECT region, round(sum(e), 6) AS loss FROM i GROUP BY 1")
def a13_asymmetric_mse(spark, sf):
    weight = F.when(_pt()[1], 1.0).otherwise(0.25)
    per = pixels(spark, sf).groupBy("region", "chip_id").agg(F.avg(weight * F.pow(F.col("v") - F.col("target"), 2)).alias("e"))
    return per.groupBy("region").agg(F.round(F.sum("e"), 6).alias("loss"))


@query(f"WITH {BAND_PIXELS} SELECT chip_id, round(avg(CASE WHEN scl <> 0 THEN (swir22 - swir16) * (swir22 - swir16) END), 1) AS mse FROM px GROUP BY 1")
def a14_mse_ignoring_missing(spark, sf):
    return band_pixels(spark, sf).groupBy("chip_id").agg(F.round(F.avg(F.when(F.col("scl") != 0, F.pow(F.col("swir22") - F.col("swir16"), 2))), 1).alias("mse"))


@query(f"WITH {PIXELS}, c AS (SELECT CAST(chip_id AS VARCHAR) AS chip_id, {_COUNTS} FROM pixels GROUP BY 1 UNION ALL SELECT 'overall', {_COUNTS} FROM pixels) SELECT * FROM c")
def a15_with_overall(spark, sf):
    p, t = _pt()
    return A.with_overall(
        pixels(spark, sf), "chip_id",
        [F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(t).alias("positives"), F.count_if(~t).alias("negatives")],
    )


@query(f"WITH {WIND} SELECT CAST(ts AS DATE) AS day, kind, count(u) AS n, max(u) AS highest, min(u) AS lowest, round(avg(u), 6) AS mean, round(stddev_samp(u), 6) AS std FROM wind GROUP BY ALL")
def a16_wind_stats(spark, sf):
    return wind(spark, sf).groupBy(F.col("ts").cast("date").alias("day"), "kind").agg(F.count("u").alias("n"), F.max("u").alias("highest"), F.min("u").alias("lowest"), F.round(F.avg("u"), 6).alias("mean"), F.round(F.stddev_samp("u"), 6).alias("std"))


@query(f"WITH {WIND}, d AS (SELECT CAST(round_even(degrees(atan2(u, v)), 0) AS INTEGER) AS degree FROM wind) SELECT degree, round(count(*) / (SELECT count(*) FROM d), 9) AS share FROM d GROUP BY 1")
def a17_value_shares(spark, sf):
    d = wind(spark, sf).select(F.rint(F.degrees(F.atan2("u", "v"))).cast("int").alias("degree"))
    counts = d.groupBy("degree").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("degree", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"WITH {WIND} SELECT kind, round(avg(u - v), 6) AS mean, round(stddev_samp(u - v), 6) AS std FROM wind GROUP BY 1")
def a18_difference_stats(spark, sf):
    return wind(spark, sf).groupBy("kind").agg(F.round(F.avg(F.col("u") - F.col("v")), 6).alias("mean"), F.round(F.stddev_samp(F.col("u") - F.col("v")), 6).alias("std"))


@query(f"WITH {SCENES} SELECT sensor, round(avg(cloud_pct), 6) AS mean_cloud, round(stddev_samp(cloud_pct), 6) AS std_cloud, round(avg(nodata_pct), 6) AS mean_nodata FROM scenes GROUP BY 1")
def a19_region_stats(spark, sf):
    return scenes(spark, sf).groupBy("sensor").agg(F.round(F.avg("cloud_pct"), 6).alias("mean_cloud"), F.round(F.stddev_samp("cloud_pct"), 6).alias("std_cloud"), F.round(F.avg("nodata_pct"), 6).alias("mean_nodata"))


@query(f"WITH {SCENES}, c AS (SELECT sensor, category, count(*) AS n FROM scenes GROUP BY ALL) SELECT sensor, array_to_string(list(concat(category, '=', printf('%.6f', s)) ORDER BY category), ' ') AS shares FROM (SELECT sensor, category, round(n / sum(n) OVER (PARTITION BY sensor), 9) AS s FROM c) GROUP BY 1")
def a20_share_map(spark, sf):
    found = A.share_map(scenes(spark, sf), ["sensor"], "category")
    text = F.array_join(F.transform(F.map_entries("shares"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), " ")
    return found.select("sensor", text.alias("shares"))


@query(f"WITH {SCENES} SELECT sensor, category, count(*) AS n, count(DISTINCT tile) AS tiles FROM scenes GROUP BY ALL")
def a21_counts(spark, sf):
    return scenes(spark, sf).groupBy("sensor", "category").agg(F.count("*").alias("n"), F.count_distinct("tile").alias("tiles"))


@query("SELECT l_returnflag AS experiment, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS lowest, max(l_quantity) AS highest, round(100 * (1 - avg(l_quantity) / (SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'N')), 6) AS faster FROM lineitem GROUP BY 1")
def a22_by_experiment(spark, sf):
    rows = load(spark, sf, "lineitem")
    q = "l_quantity"
    base = rows.where("l_returnflag = 'N'").agg(F.avg(q).alias("_base"))  # one row
    stats = rows.groupBy(F.col("l_returnflag").alias("experiment")).agg(F.avg(q).alias("m"), F.round(F.var_samp(q), 6).alias("var"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("lowest"), F.max(q).alias("highest"))
    return stats.crossJoin(F.broadcast(base)).select("experiment", F.round("m", 6).alias("mean"), "var", "std", "lowest", "highest", F.round(100 * (1 - F.col("m") / F.col("_base")), 6).alias("faster"))


@query("""WITH s AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS mean_a, avg(l_quantity) FILTER (l_returnflag = 'R') AS mean_b, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS var_a, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS var_b, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem)
SELECT round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(var_a, 6) AS var_a, round(var_b, 6) AS var_b, round((mean_a - mean_b) / sqrt(var_a / na + var_b / nb), 6) AS t, round(pow(var_a / na + var_b / nb, 2) / (pow(var_a / na, 2) / (na - 1) + pow(var_b / nb, 2) / (nb - 1)), 2) AS df FROM s""")
def a23_welch(spark, sf):
    rows = load(spark, sf, "lineitem").where("l_returnflag IN ('A', 'R')")
    found = A.welch(rows, F.col("l_returnflag") == "A", F.col("l_quantity"))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "var_a", "var_b", "t")], F.round("df", 2).alias("df"))


_ERR = "e AS (SELECT l_returnflag AS algo, l_discount - 0.05 AS root_area, l_tax - 0.04 AS major_axis, l_quantity / 50 - 0.5 AS circle FROM lineitem), u AS (UNPIVOT e ON root_area, major_axis, circle INTO NAME method VALUE error), s AS (SELECT algo, method, round(avg(abs(error)), 6) AS mape, round(sqrt(avg(error * error)), 6) AS rmspe, round(avg(error), 6) AS mpe FROM u GROUP BY ALL)"


def _errors(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("algo"), (F.col("l_discount") - 0.05).alias("root_area"), (F.col("l_tax") - 0.04).alias("major_axis"), (F.col("l_quantity") / 50 - 0.5).alias("circle"))
    found = A.error_summary(rows, ["algo"], ["root_area", "major_axis", "circle"])
    return found.select("algo", "method", *[F.round(c, 6).alias(c) for c in ("mape", "rmspe", "mpe")])


@query(f"WITH {_ERR} SELECT * FROM s")
def a24_error_summary(spark, sf):
    return _errors(spark, sf)


@query(f"WITH {_ERR} SELECT algo, method FROM (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY mape, method) AS k FROM s) WHERE k = 1")
def a25_best_method(spark, sf):
    return _errors(spark, sf).groupBy("algo").agg(F.min(F.struct("mape", "method")).alias("b")).select("algo", "b.method")


@query("SELECT l_linenumber AS threshold, round(median(abs(ln(l_extendedprice / 40000))), 6) AS error FROM lineitem GROUP BY 1")
def a26_median_log_error(spark, sf):
    rows = load(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "threshold")
    found = QT.exact_quantiles(rows, ["threshold"], F.abs(F.ln(F.col("l_extendedprice") / 40000)), [0.5])
    return found.select("threshold", F.round(F.col("quantiles")[0], 6).alias("error"))


@query(f"WITH {WIND}, g AS (SELECT station, ts, epoch_us(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) / 1e6 AS gap FROM wind) SELECT station, round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS duration, round(max(gap), 6) AS largest FROM g GROUP BY 1")
def a27_duration_and_gap(spark, sf):
    found = SE.spans(wind(spark, sf), ["station"], "ts", "event_id")
    return found.select("station", F.round("duration", 6).alias("duration"), F.round("largest", 6).alias("largest"))


@query(f"WITH {PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY region, row, col ORDER BY chip_id DESC) AS k FROM pixels) SELECT region, row, col, round(avg(v) FILTER (k <= 10), 6) AS mean, round(median(v) FILTER (k <= 5), 6) AS middle FROM r WHERE k <= 10 GROUP BY ALL")
def a28_reference_stack(spark, sf):
    # references are ranked as chips, before their pixels are made
    newest = Q.top_per_key(chips(spark, sf).select("chip_id", "region"), ["region"], [F.col("chip_id").desc()], 10).select("chip_id", "rank")
    found = RR.reference_stack(pixels(spark, sf).join(newest, "chip_id"), ["region"], "rank", "v", 10, 5)
    return found.withColumns({"mean": F.round("mean", 6), "middle": F.round("middle", 6)})


@query(f"WITH {PIXELS} SELECT chip_id, max(prob) AS highest, round(avg(prob), 6) AS mean, round(sum(abs(prob * cond)), 6) AS total FROM pixels WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 GROUP BY 1".replace("max(prob)", "round(max(prob), 9)"))
def a29_centre_buffer(spark, sf):
    found = RR.centre_buffer(pixels(spark, sf), ["chip_id"], "prob", "cond", 8, 2)
    return found.select("chip_id", F.round("highest", 9).alias("highest"), F.round("mean", 6).alias("mean"), F.round("total", 6).alias("total"))


@query(f"WITH {BAND_PIXELS} SELECT chip_id, round(coalesce(median(swir22 / nullif(CASE WHEN scl = 0 THEN 0 ELSE swir16 END, 0)), 0), 9) AS weight FROM px GROUP BY 1")
def a31_median_weight(spark, sf):
    reference = F.when(F.col("scl") == 0, 0.0).otherwise(F.col("swir16"))
    found = QT.exact_quantiles(band_pixels(spark, sf), ["chip_id"], F.try_divide("swir22", reference), [0.5])
    return found.select("chip_id", F.round(F.coalesce(F.col("quantiles")[0], F.lit(0.0)), 9).alias("weight"))


@query(f"WITH {SCENES}, m AS (SELECT *, CASE WHEN granule_id % 4 <> 0 THEN cloud_pct END AS c FROM scenes) SELECT granule_id, round(coalesce(c, avg(c) OVER (PARTITION BY sensor)), 6) AS c FROM m")
def a32_fill_with_mean(spark, sf):
    rows = scenes(spark, sf).select("granule_id", "sensor", F.when(F.col("granule_id") % 4 != 0, F.col("cloud_pct")).alias("c"))
    return A.with_group_mean(rows, "c", ["sensor"]).select("granule_id", F.round("c", 6).alias("c"))


@query("SELECT l_orderkey AS chip_id, CAST(count(DISTINCT l_partkey) AS INTEGER) AS plumes FROM lineitem GROUP BY 1")
def a33_plumes_per_chip(spark, sf):
    files = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chip_id")).agg(F.collect_set("l_partkey").alias("files"))
    return files.select("chip_id", F.size("files").alias("plumes"))


@query(f"WITH {BAND_PIXELS} SELECT granule, round(100 * count(*) FILTER (qa % 256 <> 255 AND qa % 256 > 100) / nullif(count(*) FILTER (qa % 256 <> 255), 0), 6) AS cloud FROM px GROUP BY 1")
def a34_scene_percent(spark, sf):
    value = F.col("qa") % 256
    return band_pixels(spark, sf).groupBy("granule").agg(F.round(100 * F.try_divide(F.count_if((value != 255) & (value > 100)), F.count_if(value != 255)), 6).alias("cloud"))


@query("SELECT l_linenumber % 4 AS shard, round(sum(l_extendedprice) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1")
def a35_shard_losses(spark, sf):
    return load(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("shard")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("loss"))


@query(f"WITH {PIXELS}, c AS (SELECT region, chip_id % 4 AS model, col % 2 AS s, prob FROM pixels WHERE row BETWEEN 2 AND 5) SELECT region, model, round(100 * sum(prob) FILTER (s = 0) / count(*) FILTER (s = 0), 6) AS even, round(100 * sum(prob) FILTER (s = 1) / count(*) FILTER (s = 1), 6) AS odd FROM c GROUP BY ALL")
def a36_centre_sum_pivot(spark, sf):
    rows = pixels(spark, sf).where(F.col("row").between(2, 5)).select("region", (F.col("chip_id") % 4).alias("model"), F.when(F.col("col") % 2 == 0, "even").otherwise("odd").alias("strategy"), "prob")
    return rows.groupBy("region", "model").pivot("strategy", ["even", "odd"]).agg(F.round(100 * F.sum("prob") / F.count("prob"), 6))


@query(f"WITH {BAND_PIXELS} SELECT granule, round(quantile_cont(swir22 / swir16, 0.005), 9) AS low, round(quantile_cont(swir22 / swir16, 0.995), 9) AS high FROM px GROUP BY 1")
def a37_display_percentiles(spark, sf):
    found = QT.exact_quantiles(band_pixels(spark, sf), ["granule"], F.col("swir22") / F.col("swir16"), [0.005, 0.995])
    return found.select("granule", F.round(F.col("quantiles")[0], 9).alias("low"), F.round(F.col("quantiles")[1], 9).alias("high"))


@query("SELECT l_returnflag AS flag, round(sum((l_quantity - 5) * l_extendedprice) FILTER (l_quantity BETWEEN 5 AND 40) / nullif(sum((l_quantity - 5) * (l_quantity - 5)) FILTER (l_quantity BETWEEN 5 AND 40), 0), 6) AS slope FROM lineitem GROUP BY 1")
def a38_slope_through_point(spark, sf):
    rows = load(spark, sf, "lineitem").where("l_quantity BETWEEN 5 AND 40").withColumnRenamed("l_returnflag", "flag")
    return RR.slope_through_point(rows, ["flag"], "l_quantity", "l_extendedprice", 5.0).withColumn("slope", F.round("slope", 6))
