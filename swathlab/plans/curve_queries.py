"""Interpolation, retrieval tables, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import curves as C
from ..operators import detectors as D
from ..operators import interp as I
from ..operators import plumes as P
from ..sources.io import written
from .bindings import BAND_PIXELS, CHIPS, CURVE, PIXELS, SIDE, WIND, band_pixels, chip_values, chips, curve, lab_sql, load, pixels, query, wind

_KNOTS = f"{CURVE}, seg AS (SELECT wavelength AS x0, response AS y0, lead(wavelength) OVER (ORDER BY wavelength) AS x1, lead(response) OVER (ORDER BY wavelength) AS y1 FROM curve), ends AS (SELECT min(wavelength) AS lo, max(wavelength) AS hi, min_by(response, wavelength) AS ylo, max_by(response, wavelength) AS yhi FROM curve)"


def _interp_sql(x: str) -> str:
    return f"CASE WHEN {x} <= lo THEN ylo WHEN {x} >= hi THEN yhi ELSE (SELECT y0 + ({x} - x0) * (y1 - y0) / (x1 - x0) FROM seg WHERE {x} >= x0 AND {x} < x1) END"


@query(f"WITH {_KNOTS}, q AS (SELECT l_orderkey AS chip_id, l_linenumber AS n, l_extendedprice, l_quantity * 1.07 - 1 AS x FROM lineitem), d AS (SELECT DISTINCT x FROM q), v AS (SELECT x, {_interp_sql('x')} AS y FROM d, ends) SELECT chip_id, n, l_extendedprice, round(y, 5) AS y FROM q JOIN v USING (x)")
def j25_interpolation_join(spark, sf):
    queries = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chip_id"), F.col("l_linenumber").alias("n"), "l_extendedprice", (F.col("l_quantity") * 1.07 - 1).alias("x"))
    return I.interpolate_curve(queries, curve(spark, sf), "x", "wavelength", "response", "y").select("chip_id", "n", "l_extendedprice", F.round("y", 5).alias("y"))


@query(f"WITH {_KNOTS}, q AS (SELECT range / 4.0 + 0.5 AS x FROM range(220)) SELECT CAST(x AS DOUBLE) AS wavelength, round({_interp_sql('x')}, 9) AS response FROM q, ends")
def t3_resample_curve(spark, sf):
    grid = spark.range(220).select((F.col("id") / 4 + 0.5).alias("wavelength"), F.lit(0).alias("k"))
    return I.interpolate_join(grid, curve(spark, sf).withColumn("k", F.lit(0)), ["k"], "wavelength", "wavelength", "response", "response").select("wavelength", F.round("response", 9).alias("response"))


_TABLE = "tab AS (SELECT range AS i, exp(-range / 40.0) AS nb FROM range(101))"


@query(f"WITH {BAND_PIXELS}, {_TABLE} SELECT chip_id, px, swir16, round(nb, 6) AS nb FROM px JOIN tab ON i = CAST(least(round_even(greatest(least((swir16 - 1000) / 90000, 1), 0) * 100, 0), 100) AS BIGINT)")
def t5_forward_lookup(spark, sf):
    from ..operators.physics import forward_lookup

    table = spark.range(101).select(F.col("id").alias("i"), F.exp(-F.col("id") / 40).alias("nb"))
    found = forward_lookup(band_pixels(spark, sf), table, F.greatest(F.least((F.col("swir16") - 1000) / 90000, F.lit(1.0)), F.lit(0.0)), 1.0, 100, "nb")
    return found.select("chip_id", "px", "swir16", F.round("nb", 6).alias("nb"))


@query(f"WITH {BAND_PIXELS}, f AS (SELECT chip_id, px, swir16, greatest(least(swir22 / swir16 - 1, exp(0.0) - 1), exp(-2.5) - 1) AS frac FROM px) SELECT chip_id, px, swir16, round(floor(-40 * ln(1 + frac) + 1e-9) + (frac - (exp(-floor(-40 * ln(1 + frac) + 1e-9) / 40) - 1)) / (exp(-(floor(-40 * ln(1 + frac) + 1e-9) + 1) / 40) - exp(-floor(-40 * ln(1 + frac) + 1e-9) / 40)), 4) AS conc FROM f")
def t6_reverse_lookup(spark, sf):
    from ..operators.physics import reverse_lookup

    table = spark.range(101).select(F.col("id").cast("double").alias("conc"), (F.exp(-F.col("id") / 40) - 1).alias("frac"))
    rows = band_pixels(spark, sf).select("chip_id", "px", "swir16", (F.col("swir22") / F.col("swir16") - 1).alias("frac"))
    return reverse_lookup(rows, table, "frac", "conc").select("chip_id", "px", "swir16", F.round("conc", 4).alias("conc"))


# -- curves ------------------------------------------------------------------------------
_T42 = [round(0.02 * i, 2) for i in range(1, 43)]
_TS = "t AS (SELECT round(range * 0.02, 2)::DOUBLE AS threshold FROM range(1, 43))"
#: Components at a floor of 0.25 with their largest probability, a chip below it as one of 0; crops of each region.
_COMP = f"""{PIXELS}, {lab_sql('cl', 0.25, 0.25)}, c AS (SELECT any_value(region) AS region, max(prob) AS score FROM cl GROUP BY chip_id, label UNION ALL SELECT region, 0 FROM pixels GROUP BY chip_id, region HAVING max(prob) < 0.25), a AS (SELECT region, count(DISTINCT chip_id) AS crops FROM pixels GROUP BY 1)"""


def _curve(spark, sf, strict):
    values = chip_values(spark, sf)
    scores = C.plume_scores(values, "chip_id", "prob", SIDE, "region", 0.25)
    return C.ccdf(scores, values.groupBy("region").agg(F.count("*").alias("crops")), "region", "score", _T42, 6.5536, 100.0, strict)


@query(f"WITH RECURSIVE {_COMP}, {_TS} SELECT c.region, threshold, round(count(*) FILTER (score > threshold) / (any_value(crops) * 6.5536::DOUBLE), 9) AS per_km2, round(count(*) FILTER (score > threshold) / (any_value(crops) * 6.5536::DOUBLE) * 100, 9) AS per_tile FROM c JOIN a USING (region), t GROUP BY ALL")
def t27_fp_curve(spark, sf):
    return _curve(spark, sf, True).select("region", "threshold", F.round("per_km2", 9).alias("per_km2"), F.round("per_tile", 9).alias("per_tile"))


_T28 = f"""{_COMP}, {_TS}, p AS (SELECT c.region, threshold, count(*) FILTER (score >= threshold) / (any_value(crops) * 6.5536::DOUBLE) * 100 AS per_tile FROM c JOIN a USING (region), t GROUP BY ALL), m AS (SELECT threshold, round(avg(per_tile), 9) AS y FROM p GROUP BY 1),
g AS (SELECT y AS x0, threshold AS y0, lead(y) OVER w AS x1, lead(threshold) OVER w AS y1, row_number() OVER w AS k, count(*) OVER () AS n FROM m WINDOW w AS (ORDER BY y, threshold DESC)), e AS (SELECT max(x0) FILTER (k = 1) AS lo, max(y0) FILTER (k = 1) AS ylo, max(x0) FILTER (k = n) AS hi, max(y0) FILTER (k = n) AS yhi FROM g), r(rate) AS (VALUES (1.0::DOUBLE), (2.0), (5.0), (10.0)),
th AS (SELECT rate, round(10 * CASE WHEN rate <= lo THEN ylo WHEN rate >= hi THEN yhi ELSE y0 + (rate - x0) * (y1 - y0) / (x1 - x0) END, 3) AS threshold FROM r CROSS JOIN e LEFT JOIN g ON rate >= x0 AND rate < x1)"""


@query(f"WITH RECURSIVE {_T28} SELECT rate, threshold FROM th")
def t28_threshold_for_fpr(spark, sf):
    return C.threshold_for_rate(_curve(spark, sf, False), [1, 2, 5, 10])


_PAIRS = [(0.9, 0.6), (0.8, 0.5), (0.7, 0.4)]
_AREAS = " UNION ALL ".join(f"SELECT region, {m}::DOUBLE AS marker, {f}::DOUBLE AS floor, chip_id FROM l{i}" for i, (m, f) in enumerate(_PAIRS))


@query(f"WITH RECURSIVE {PIXELS}, {', '.join(lab_sql(f'l{i}', m, f) for i, (m, f) in enumerate(_PAIRS))}, s AS ({_AREAS}), k(marker, floor) AS (VALUES {', '.join(f'({m}::DOUBLE, {f}::DOUBLE)' for m, f in _PAIRS)}), c AS (SELECT region, count(*) AS crops FROM chips GROUP BY 1) SELECT c.region, k.marker, k.floor, round(count(s.chip_id) / any_value(crops) * (100 / 6.5536::DOUBLE), 6) AS fp_px FROM c CROSS JOIN k LEFT JOIN s ON c.region = s.region AND k.marker = s.marker AND k.floor = s.floor GROUP BY ALL")
def t29_fp_pixels_per_tile(spark, sf):
    found = C.false_positive_area(chip_values(spark, sf), "prob", SIDE, "region", _PAIRS, 100 / 6.5536)
    return found.withColumn("fp_px", F.round("fp_px", 6))


_SCORES = "sc AS (SELECT region, chip_id, row AS plume, CAST(100 * (1 + col) AS INTEGER) AS rate, CASE WHEN v < -0.2 THEN NULL ELSE prob + col / 40.0 END AS score FROM pixels)"


def _scores(spark, sf):
    rows = pixels(spark, sf)
    return rows.select("region", "chip_id", F.col("row").alias("plume"), (100 * (1 + F.col("col"))).cast("int").alias("rate"), F.when(F.col("v") >= -0.2, F.col("prob") + F.col("col") / 40).alias("score"))


@query(f"WITH RECURSIVE {_T28}, {_SCORES}, d AS (SELECT th.rate AS fpr, sc.region, sc.rate, chip_id, avg(CAST(coalesce(score > th.threshold / 10, FALSE) AS DOUBLE)) AS p FROM sc, th GROUP BY ALL) SELECT fpr, region, rate, round(100 * avg(p), 6) AS mean, round(100 * stddev_pop(p), 6) AS std FROM d GROUP BY ALL")
def t30_detection_probability(spark, sf):
    # a threshold for each of the four rates
    levels = {r["rate"]: r["threshold"] / 10 for r in t28_threshold_for_fpr(spark, sf).collect()}
    found = C.detection_by_rate(_scores(spark, sf), ["region", "rate"], "chip_id", F.col("score"), levels)
    return found.select("fpr", "region", "rate", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


#: Half rows are plumes, columns their emission rates.
@query(f"""WITH RECURSIVE {PIXELS}, {', '.join(lab_sql(f'l{i}', m, f) for i, (m, f) in enumerate(_PAIRS))}, s AS ({' UNION ALL '.join(f'SELECT {m}::DOUBLE AS marker, {f}::DOUBLE AS floor, chip_id, row, col FROM l{i}' for i, (m, f) in enumerate(_PAIRS))}),
k(marker, floor) AS (VALUES {', '.join(f'({m}::DOUBLE, {f}::DOUBLE)' for m, f in _PAIRS)}), q AS (SELECT region, chip_id, row, col, row // 4 AS plume, 100 * (1 + col) AS rate, abs(target) >= 0.1 AS truth, prob FROM pixels),
u AS (SELECT q.region, q.chip_id, plume, rate, k.marker, k.floor, count(*) FILTER (truth) AS n, max(prob) FILTER (truth) AS top, count(s.chip_id) FILTER (truth) AS hits FROM q CROSS JOIN k LEFT JOIN s ON s.marker = k.marker AND s.floor = k.floor AND s.chip_id = q.chip_id AND s.row = q.row AND s.col = q.col GROUP BY ALL),
c AS (SELECT region, chip_id, rate, marker, floor, coalesce(avg(CASE WHEN n > 0 THEN CASE WHEN top >= marker THEN hits / n ELSE 0 END END), 0) AS r FROM u GROUP BY ALL)
SELECT region, CAST(rate AS INTEGER) AS rate, marker, floor, round(100 * avg(r), 6) AS mean, round(100 * stddev_pop(r), 6) AS std FROM c GROUP BY ALL""")
def t31_pixel_recall(spark, sf):
    which = F.transform("target", lambda t, i: F.when(F.abs(t) >= 0.1, (F.floor(i / 32) * SIDE + i % SIDE).cast("int")))
    hits = P.component_hits(chip_values(spark, sf).withColumn("plume", which), ("region", "chip_id"), "prob", "plume", 2 * SIDE, SIDE, _PAIRS)
    found = C.pixel_recall(hits.withColumn("rate", 100 * (1 + F.col("plume") % SIDE)), ["region", "rate"], "chip_id", _PAIRS)
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _level_sql(level: int) -> str:
    return f"CAST(round_even(CASE WHEN {level} <= lo THEN ylo WHEN {level} >= hi THEN yhi ELSE (SELECT max(y0 + ({level} - x0) * (y1 - y0) / (x1 - x0)) FROM g WHERE g.region = e.region AND {level} >= x0 AND {level} < x1) END, 0) AS BIGINT)"


@query(f"""WITH {PIXELS}, {_SCORES}, p AS (SELECT region, rate, chip_id, avg(CAST(coalesce(score > 0.55, FALSE) AS DOUBLE)) AS p FROM sc GROUP BY ALL), m AS (SELECT region, rate::DOUBLE AS rate, round(100 * avg(p), 6) AS mean FROM p GROUP BY ALL),
g AS (SELECT region, mean AS x0, rate AS y0, lead(mean) OVER w AS x1, lead(rate) OVER w AS y1, row_number() OVER w AS k, count(*) OVER (PARTITION BY region) AS n FROM m WINDOW w AS (PARTITION BY region ORDER BY mean, rate)),
e AS (SELECT region, max(x0) FILTER (k = 1) AS lo, max(y0) FILTER (k = 1) AS ylo, max(x0) FILTER (k = n) AS hi, max(y0) FILTER (k = n) AS yhi, CAST(arg_min(y0, k) FILTER (x0 > 0.01) AS BIGINT) AS minimum FROM g GROUP BY 1)
SELECT region, greatest({_level_sql(10)}, minimum) AS pod10, {_level_sql(50)} AS pod50, {_level_sql(90)} AS pod90, minimum FROM e""")
def t32_pod_levels(spark, sf):
    found = C.detection_probability(_scores(spark, sf), ["region", "rate"], "chip_id", F.col("score") > 0.55)
    return C.pod_levels(found.withColumn("mean", F.round("mean", 6)), ["region"], "rate", "mean")


def _level_by_rate(level: int) -> str:
    return f"CAST(round_even(CASE WHEN {level} <= lo THEN ylo WHEN {level} >= hi THEN yhi ELSE (SELECT max(y0 + ({level} - x0) * (y1 - y0) / (x1 - x0)) FROM kn WHERE kn.fpr = en.fpr AND kn.region = en.region AND {level} >= x0 AND {level} < x1) END, 0) AS BIGINT)"


@query(f"""WITH RECURSIVE {_T28}, {_SCORES}, d AS (SELECT th.rate AS fpr, sc.region, sc.rate, chip_id, avg(CAST(coalesce(score > th.threshold / 10, FALSE) AS DOUBLE)) AS p FROM sc, th GROUP BY ALL), mn AS (SELECT fpr, region, rate::DOUBLE AS rate, round(100 * avg(p), 6) AS mean FROM d GROUP BY ALL),
kn AS (SELECT fpr, region, mean AS x0, rate AS y0, lead(mean) OVER w AS x1, lead(rate) OVER w AS y1, row_number() OVER w AS k, count(*) OVER (PARTITION BY fpr, region) AS n FROM mn WINDOW w AS (PARTITION BY fpr, region ORDER BY mean, rate)),
en AS (SELECT fpr, region, max(x0) FILTER (k = 1) AS lo, max(y0) FILTER (k = 1) AS ylo, max(x0) FILTER (k = n) AS hi, max(y0) FILTER (k = n) AS yhi, CAST(arg_min(y0, k) FILTER (x0 > 0.01) AS BIGINT) AS minimum FROM kn GROUP BY ALL)
SELECT fpr, region, greatest({_level_by_rate(10)}, minimum) AS pod10, {_level_by_rate(50)} AS pod50, {_level_by_rate(90)} AS pod90, minimum FROM en""")
def t32_levels_by_rate(spark, sf):
    return C.pod_levels(t30_detection_probability(spark, sf), ["fpr", "region"], "rate", "mean")


@query("SELECT o_orderkey AS granule_id, unnest(list_concat(list_concat(range(100, 1000, 100), range(1000, 2000, 200)), list_concat(list_concat(range(2000, 4000, 400), range(4000, 10000, 1000)), range(10000, 25100, 5000)))) AS rate FROM orders")
def t33_emission_grid(spark, sf):
    chosen = load(spark, sf, "orders").select(F.col("o_orderkey").alias("granule_id"))
    return chosen.withColumn("rate", F.explode(F.array(*[F.lit(r).cast("long") for r in C.emission_grid()])))


_T20 = [round(0.3 + 0.03 * i, 2) for i in range(20)]


#: Scores in 255 steps, by chip and truth.
_HIST = f"""{PIXELS}, lv AS (SELECT region, chip_id, (chip_id * 37) % 1600 AS e, chip_id % 2 = 0 AS clean, CAST(round_even(prob * 255, 0) AS INTEGER) AS level, abs(target) > 0.1 AS truth, v, cond, target FROM pixels)"""
_T34 = f"""{_HIST}, t AS (SELECT round(0.3 + 0.03 * range, 2)::DOUBLE AS threshold FROM range(20)), f AS (SELECT region, threshold, count(*) FILTER (level > threshold * 255) / count(DISTINCT chip_id) AS fp FROM lv, t WHERE clean GROUP BY ALL), m AS (SELECT threshold, avg(fp) AS fp FROM f GROUP BY 1),
l AS (SELECT *, lag(threshold) OVER (ORDER BY threshold) AS t0, lag(fp) OVER (ORDER BY threshold) AS fp0 FROM m), th AS (SELECT coalesce(min_by(CASE WHEN t0 IS NULL THEN threshold ELSE t0 + (10 - fp0) / (fp - fp0) * (threshold - t0) END, threshold) FILTER (fp < 10), max(threshold)) AS threshold FROM l)"""


def _histogram(spark, sf):
    truth = F.abs("target") > 0.1
    return C.score_histogram(
        pixels(spark, sf), "region", "chip_id", (F.col("chip_id") * 37) % 1600, F.col("chip_id") % 2 == 0, F.col("prob"), truth, F.col("cond"), F.col("target"), S.bce_with_logits("v", truth.cast("double"))
    )


@query(f"WITH {_T34} SELECT round(threshold, 6) AS threshold FROM th")
def t34_fp_pixel_threshold(spark, sf):
    return C.false_positive_threshold(_histogram(spark, sf), "region", "chip_id", _T20, 10.0).select(F.round("threshold", 6).alias("threshold"))


_BIN = "CASE WHEN e <= 0 THEN NULL WHEN e <= 100 THEN 0 WHEN e <= 200 THEN 1 WHEN e <= 300 THEN 2 WHEN e <= 500 THEN 3 WHEN e <= 750 THEN 4 WHEN e <= 1250 THEN 5 ELSE 6 END"
_BINS = ", ".join(f"coalesce(avg(100 * tp / (tp + fn + 0.00001)) FILTER (bin = {i}), 0) AS r{i}" for i in range(7))


@query(f"""WITH {_HIST}, p AS (SELECT region, chip_id, {_BIN} AS bin, count(*) FILTER (level > 0.6::DOUBLE * 255 AND truth) AS tp, count(*) FILTER (NOT level > 0.6::DOUBLE * 255 AND truth) AS fn FROM lv GROUP BY region, chip_id, e),
b AS (SELECT region, {_BINS} FROM p GROUP BY 1), u AS ({' UNION ALL '.join(f'SELECT region, {i} AS bin, r{i} AS recall FROM b' for i in range(7))}) SELECT region, bin, round(recall, 6) AS recall FROM u""")
def t35_recall_by_bin(spark, sf):
    return C.recall_table(_histogram(spark, sf), "region", "chip_id", 0.6).withColumn("recall", F.round("recall", 6))


_SUMS = "sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(er) AS er, sum(b) AS b, sum(cm) AS cm"
_BCE = "greatest(v, 0) - v * CAST(truth AS INTEGER) + ln(1 + exp(-abs(v)))"


@query(f"""WITH {_T34}, q AS (SELECT lv.*, level > threshold * 255 AS found FROM lv, th), k AS (SELECT region, chip_id, {_BIN} AS bin, count(*) FILTER (found AND truth) AS tp, count(*) FILTER (NOT found AND NOT truth) AS tn, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND truth) AS fn,
sum(pow(cond - target, 2)) AS er, coalesce(sum(pow(cond - target, 2)) FILTER (truth), 0) AS cm, sum({_BCE}) AS b FROM q GROUP BY region, chip_id, e),
g AS (SELECT region, avg(cond) FILTER (truth) / nullif(stddev_pop(cond) FILTER (NOT truth), 0) AS snr FROM lv GROUP BY 1), o AS (SELECT k.region, count(*) AS chips, {_SUMS}, {_BINS}, any_value(snr) AS snr FROM k JOIN g USING (region) GROUP BY 1),
u AS (SELECT * FROM o UNION ALL BY NAME SELECT NULL AS region, sum(chips) AS chips, {_SUMS}, {', '.join(f'avg(r{i}) AS r{i}' for i in range(7))}, (SELECT avg(cond) FILTER (truth) / nullif(stddev_pop(cond) FILTER (NOT truth), 0) FROM lv) AS snr FROM o)
SELECT region, round(threshold, 6) AS threshold, CAST(chips AS BIGINT) AS chips, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('tp', 'tn', 'fp', 'fn'))}, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS pixel_recall, round(fp / nullif(fp + tn, 0), 9) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1,
round(snr, 5) AS snr, round(er / chips, 5) AS mse, round(b / chips, 5) AS bce, round(cm / chips, 5) AS cond_mse, round((b + cm) / chips, 5) AS loss, {', '.join(f'round(r{i}, 5) AS recall_{i}' for i in range(7))}, round(({' + '.join(f'r{i}' for i in range(7))}) / 7, 5) AS recall FROM u, th""")
def t36_validation_report(spark, sf):
    found = C.validation_report(written(_histogram(spark, sf), "scores"), "region", "chip_id", _T20, 10.0)
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "pixel_recall", "fpr", "f1")] + [F.round(c, 5).alias(c) for c in ("snr", "mse", "bce", "cond_mse", "loss")]
    return found.select("region", F.round("threshold", 6).alias("threshold"), "chips", "tp", "tn", "fp", "fn", *rounded, *[F.round(F.col("recalls")[i], 5).alias(f"recall_{i}") for i in range(7)], F.round("recall", 5).alias("recall"))


@query(f"WITH {PIXELS}, m AS (SELECT chip_id, count(*) FILTER (prob >= 0.6 AND abs(target) > 0.1) AS tp, count(*) FILTER (prob >= 0.6 AND NOT abs(target) > 0.1) AS fp FROM pixels GROUP BY 1) SELECT m.*, label FROM m JOIN embeddings ON chip_id = vec_id")
def t37_chip_metrics(spark, sf):
    truth, found = F.abs("target") > 0.1, F.col("prob") >= 0.6
    metrics = pixels(spark, sf).groupBy("chip_id").agg(F.count_if(found & truth).alias("tp"), F.count_if(found & ~truth).alias("fp"))
    return metrics.join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("chip_id"), "label"), "chip_id")


@query(f"WITH {PIXELS}, {_SCORES}, t AS (SELECT (range * 0.1)::DOUBLE AS t FROM range(3, 9)) SELECT rate, round(t, 1) AS threshold, round(avg(CAST(coalesce(score > round(t, 1), FALSE) AS DOUBLE)), 9) AS share FROM sc, t GROUP BY ALL")
def t44_simple_detection(spark, sf):
    found = C.counts_above(_scores(spark, sf), ["rate"], F.col("score"), [round(0.1 * i, 1) for i in range(3, 9)])
    return found.select("rate", "threshold", F.round(F.col("n") / F.col("rows"), 9).alias("share"))


# -- wind on a regular grid ----------------------------------------------------------------
@query(f"""WITH {WIND}, s AS (SELECT station, min(ts) AS t0, max(ts) AS t1 FROM wind GROUP BY 1), g AS (SELECT station, unnest(range(date_trunc('hour', t0) + INTERVAL 1 HOUR, t1, INTERVAL 6 HOUR)) AS moment FROM s),
k AS (SELECT station, ts, min(u) AS u FROM wind GROUP BY ALL), n AS (SELECT station, ts AS x0, u AS y0, lead(ts) OVER (PARTITION BY station ORDER BY ts) AS x1, lead(u) OVER (PARTITION BY station ORDER BY ts) AS y1 FROM k)
SELECT g.station, moment, round(y0 + epoch_us(moment - x0) * (y1 - y0) / epoch_us(x1 - x0), 5) AS u FROM g JOIN n ON g.station = n.station AND moment >= x0 AND moment < x1""")
def d6_regular_wind(spark, sf):
    rows = wind(spark, sf).select("station", F.col("ts").cast("timestamp").alias("ts"), "u")
    span = rows.groupBy("station").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    first = F.date_trunc("hour", "t0") + F.expr("INTERVAL 1 HOUR")
    grid = span.where(first < F.col("t1")).select("station", F.explode(F.sequence(first, F.col("t1"), F.expr("INTERVAL 6 HOURS"))).alias("at"), "t1").where("at < t1").drop("t1")
    knots = rows.groupBy("station", "ts").agg(F.min("u").alias("u")).select("station", F.unix_micros("ts").alias("x"), "u")
    found = I.interpolate_join(grid.withColumn("q", F.unix_micros("at")), knots, ["station"], "q", "x", "u", "u")
    return found.select("station", F.col("at").alias("moment"), F.round("u", 5).alias("u"))


@query("SELECT granule_id, unnest(range(acquired, acquired + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS day FROM (SELECT o_orderkey AS granule_id, o_orderdate AS acquired FROM orders)")
def d3_days_between(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("granule_id"), F.col("o_orderdate").alias("acquired"))
    return rows.select("granule_id", F.explode(F.sequence("acquired", F.col("acquired") + F.expr("INTERVAL 2 DAY"), F.expr("INTERVAL 1 DAY"))).alias("day"))


# -- detectors -----------------------------------------------------------------------------
_CLIP = "round(CASE WHEN {0} > 0 THEN 0 WHEN {0} < -0.7715 THEN -0.7715 ELSE {0} END, 6) AS {0}"


@query(f"""WITH {BAND_PIXELS}, q AS (SELECT *, coalesce((swir22 - swir16) / nullif(swir16, 0), 0) AS t, coalesce((swir22_ref - swir16_ref) / nullif(swir16_ref, 0), 0) AS r FROM px),
w AS (SELECT chip_id, coalesce(median(swir22 / nullif(swir22_ref, 0)), 0) AS c, coalesce(median(round(t / nullif(r, 0), 9)), 0) AS m FROM q GROUP BY 1),
f AS (SELECT chip_id, px, swir16, coalesce((swir22 - c * swir22_ref) / nullif(c * swir22_ref, 0), 0) AS sbmp, t AS mbsp, coalesce((t - m * r) / nullif(m * r, 0), 0) AS mbmp FROM q JOIN w USING (chip_id))
SELECT chip_id, px, swir16, {_CLIP.format("sbmp")}, {_CLIP.format("mbsp")}, {_CLIP.format("mbmp")}, 0.0::DOUBLE AS zero FROM f""")
def m6_baseline_detector(spark, sf):
    found = D.baseline_detectors(band_pixels(spark, sf), ["chip_id"], "swir16", "swir22", "swir16_ref", "swir22_ref")
    return found.select("chip_id", "px", "swir16", *[F.round(c, 6).alias(c) for c in ("sbmp", "mbsp", "mbmp", "zero")])


_LOOKED = "CASE WHEN {0} > 0 THEN 0 WHEN {0} < -0.7715 THEN -0.6149 ELSE {0} END"


@query(f"""WITH {BAND_PIXELS}, lk AS (SELECT -0.77 * (1 - exp(-range / 25.0)) AS x, -0.61 * (1 - exp(-range / 30.0)) AS y FROM range(101)), seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM lk), ends AS (SELECT min(x) AS lo, max(x) AS hi, min_by(y, x) AS ylo, max_by(y, x) AS yhi FROM lk),
q AS (SELECT *, coalesce((swir22 - swir16) / nullif(swir16, 0), 0) AS t, coalesce((swir22_ref - swir16_ref) / nullif(swir16_ref, 0), 0) AS r FROM px), w AS (SELECT chip_id, coalesce(median(swir22 / nullif(swir22_ref, 0)), 0) AS c, coalesce(median(round(t / nullif(r, 0), 9)), 0) AS m FROM q GROUP BY 1),
f AS (SELECT chip_id, px, swir16, coalesce((swir22 - c * swir22_ref) / nullif(c * swir22_ref, 0), 0) AS sbmp, t AS mbsp, coalesce((t - m * r) / nullif(m * r, 0), 0) AS mbmp FROM q JOIN w USING (chip_id)), u AS (SELECT chip_id, px, swir16, {', '.join(f'{_LOOKED.format(k)} AS {k}' for k in ('sbmp', 'mbsp', 'mbmp'))} FROM f)
SELECT chip_id, px, swir16, {', '.join(f'round({_interp_sql(k)}, 6) AS {k}' for k in ('sbmp', 'mbsp', 'mbmp'))}, 0.0::DOUBLE AS zero FROM u, ends""")
def m6_lookup_detector(spark, sf):
    i = F.col("id")
    table = spark.range(101).select((-0.77 * (1 - F.exp(-i / 25))).alias("frac"), (-0.61 * (1 - F.exp(-i / 30))).alias("value"))
    found = D.baseline_detectors(band_pixels(spark, sf), ["chip_id"], "swir16", "swir22", "swir16_ref", "swir22_ref", table)
    return found.select("chip_id", "px", "swir16", *[F.round(c, 6).alias(c) for c in ("sbmp", "mbsp", "mbmp", "zero")])


@query(f"""WITH {BAND_PIXELS}, w AS (SELECT chip_id, median(swir16 / nullif(swir22, 0)) AS ct, median(swir16_ref / nullif(swir22_ref, 0)) AS cr FROM px GROUP BY 1) SELECT p.chip_id, px, swir16, round(ct * swir22 / swir16 - cr * swir22_ref / swir16_ref, 6) AS mbmp FROM px p JOIN w USING (chip_id)""")
def m7_approximate_mbmp(spark, sf):
    rows = band_pixels(spark, sf)
    w = rows.groupBy("chip_id").agg(F.median(F.try_divide("swir16", "swir22")).alias("ct"), F.median(F.try_divide("swir16_ref", "swir22_ref")).alias("cr"))
    value = F.col("ct") * S.band_ratio("swir22", "swir16") - F.col("cr") * S.band_ratio("swir22_ref", "swir16_ref")
    return rows.join(w, "chip_id").select("chip_id", "px", "swir16", F.round(value, 6).alias("mbmp"))


@query(f"WITH {CHIPS} SELECT a.chip_id, array_to_string(list_transform(range(64), lambda i: CAST(round_even(1000 * (a.raster[i + 1] - (b.raster[i + 1] + c.raster[i + 1]) / 2), 0) AS BIGINT)), ' ') AS change FROM chips a JOIN chips b ON b.chip_id = a.chip_id + 1 JOIN chips c ON c.chip_id = a.chip_id + 2")
def m29_ratio_change(spark, sf):
    c = chips(spark, sf)
    before = c.select((F.col("chip_id") - 1).alias("chip_id"), F.col("raster").alias("b"))
    earlier = c.select((F.col("chip_id") - 2).alias("chip_id"), F.col("raster").alias("e"))
    means = F.zip_with("b", "e", lambda x, y: (x + y) / 2)
    change = F.zip_with("raster", means, lambda x, y: F.rint(1000 * (x - y)).cast("long").cast("string"))
    return c.join(before, "chip_id").join(earlier, "chip_id").select("chip_id", F.array_join(change, " ").alias("change"))


#: Four chips behind each other are a series.
@query(f"""WITH {CHIPS}, d AS (SELECT a.chip_id // 4 AS series, a.chip_id AS newer, b.chip_id AS older, list_transform(range(64), lambda i: a.raster[i + 1] - b.raster[i + 1]) AS change FROM chips a JOIN chips b ON b.chip_id // 4 = a.chip_id // 4 AND b.chip_id < a.chip_id), m AS (SELECT *, list_sum(change) / 64 AS mean FROM d)
SELECT series, newer, older, array_to_string(list_transform(change, lambda x: CAST(CAST(round_even(1000 * (x - mean), 0) AS BIGINT) AS VARCHAR)), ' ') AS change FROM m""")
def m29_pairwise_changes(spark, sf):
    rows = chips(spark, sf).withColumn("series", F.floor(F.col("chip_id") / 4))
    found = D.pairwise_changes(rows, ["series"], "chip_id", "raster")
    return found.withColumn("change", F.array_join(F.transform("change", lambda x: F.rint(1000 * x).cast("long").cast("string")), " "))


@query("SELECT chip, CAST(row AS BIGINT) * 8 AS crop_y, CAST(col AS BIGINT) * 8 AS crop_x FROM (SELECT c_custkey AS chip, unnest(range(CAST(floor(abs(c_acctbal) / 1000) AS BIGINT))) AS row, c_custkey % 3 + 1 AS nc FROM customer) a, LATERAL (SELECT unnest(range(nc)) AS col) b")
def m22_grid_coordinates(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("chip"), F.floor(F.abs("c_acctbal") / 1000).alias("nr"), (F.col("c_custkey") % 3 + 1).alias("nc")).where("nr > 0")
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)))
    return rows.select("chip", (F.col("row") * 8).alias("crop_y"), (F.col("col") * 8).alias("crop_x"))
