"""Components, their emission rates, masks and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions import scalar as S
from ..operators import placement as PL
from ..operators import plumes as P
from ..operators import rasters as RR
from .bindings import BAND_PIXELS, CHIPS, PIXELS, SIDE, WIND, band_pixels, chip_values, chips, lab_sql, load, pixels, query, wind

MARKER, FLOOR = 0.85, 0.65
_LAB = f"{PIXELS}, {lab_sql('lab', MARKER, FLOOR)}"


def _rectangle(keys: str, corners: str) -> str:
    """SQL of the least-area rectangle's longer side, over the directions of all pairs of corners (the hull's edges are among them)."""
    return f"""dirs AS (SELECT DISTINCT {keys}, b.x - a.x AS dx, b.y - a.y AS dy FROM {corners} a JOIN {corners} b USING ({keys}) WHERE b.y > a.y OR (b.y = a.y AND b.x > a.x)),
turned AS (SELECT {keys}, dx, dy, max(x * dx + y * dy) - min(x * dx + y * dy) AS a, max(y * dx - x * dy) - min(y * dx - x * dy) AS b FROM dirs JOIN {corners} USING ({keys}) GROUP BY ALL),
rectangle AS (SELECT {keys}, greatest(a, b) / sqrt(dx * dx + dy * dy) AS length FROM turned QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(a * b / (dx * dx + dy * dy), 6), round(greatest(a, b) / sqrt(dx * dx + dy * dy), 9)) = 1)"""


def _labels(spark, sf):
    return P.label_chips(chip_values(spark, sf), "chip_id", "prob", SIDE, MARKER, FLOOR)


def _labelled(spark, sf):
    """Labelled pixels with their values."""
    return P.label_chips(chip_values(spark, sf), "chip_id", "prob", SIDE, MARKER, FLOOR, values=("prob", "cond", "target"), keep=("region",))


@query(f"WITH RECURSIVE {_LAB} SELECT chip_id, row, col, label FROM lab")
def t12_components(spark, sf):
    return _labels(spark, sf)


@query(f"WITH RECURSIVE {_LAB} SELECT chip_id, label, count(*) AS area, min(row) AS r0, min(col) AS c0, max(row) + 1 AS r1, max(col) + 1 AS c1, round(max(prob), 9) AS max, round(avg(prob), 6) AS mean, round(stddev_pop(prob), 6) AS std FROM lab GROUP BY ALL")
def t13_properties(spark, sf):
    found = P.properties(_labelled(spark, sf), ["chip_id"], "prob")
    return found.withColumns({"max": F.round("max", 9), "mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH RECURSIVE {_LAB} SELECT chip_id, label FROM (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY (row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5), row, col) AS k FROM lab WHERE (row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5) <= 9) WHERE k = 1")
def t14_central_plume(spark, sf):
    return P.central_plume(_labels(spark, sf), ["chip_id"], SIDE, 3.0)


@query(f"WITH RECURSIVE {_LAB} SELECT chip_id, label, 500000 + (col + 0.5) * 20 AS x, 4000000 - (row + 0.5) * 20 AS y FROM (SELECT *, row_number() OVER (PARTITION BY chip_id, label ORDER BY prob DESC, row, col) AS k FROM lab) WHERE k = 1")
def t15_source_location(spark, sf):
    return P.source_location(_labelled(spark, sf), ["chip_id"], "prob", 500000.0, 4000000.0, 20.0)


_AREA = "SELECT chip_id, label, count(*) FILTER (cond > 0) * 400.0::DOUBLE AS area, sqrt(count(*) FILTER (cond > 0) * 400.0::DOUBLE) AS length, coalesce(sum(cond) FILTER (cond > 0), 0) * 400.0::DOUBLE AS ime FROM lab GROUP BY ALL"


@query(f"WITH RECURSIVE {_LAB}, a AS ({_AREA}) SELECT chip_id, label, area, round(length, 6) AS length, round(ime, 6) AS ime FROM a")
def t16_area_length_ime(spark, sf):
    found = P.area_length_ime(_labelled(spark, sf), ["chip_id", "label"], "cond", 20.0)
    return found.withColumns({"length": F.round("length", 6), "ime": F.round("ime", 6)})


@query("SELECT l_orderkey AS chip_id, l_linenumber AS n, l_extendedprice, round(l_quantity / (l_discount + 1) * l_tax * 57.75286, 6) AS rate FROM lineitem")
def t17_emission_rate(spark, sf):
    rows = load(spark, sf, "lineitem").withColumn("length", F.col("l_discount") + 1)
    return rows.select(F.col("l_orderkey").alias("chip_id"), F.col("l_linenumber").alias("n"), "l_extendedprice", F.round(S.emission_rate("l_quantity", "length", "l_tax"), 6).alias("rate"))


@query(f"WITH RECURSIVE {_LAB}, a AS ({_AREA}) SELECT chip_id, label, round(2.5 / nullif(length, 0) * ime * 57.75286, 5) AS rate FROM a")
def t18_root_area_rate(spark, sf):
    return P.root_area_rate(_labelled(spark, sf), ["chip_id", "label"], "cond", 20.0, 2.5).select("chip_id", "label", F.round("rate", 5).alias("rate"))


@query(f"""WITH RECURSIVE {_LAB}, e AS (SELECT chip_id, label, row, min(col) AS a, max(col) + 1 AS b FROM lab GROUP BY ALL), k AS (SELECT chip_id, label, row + d AS y, unnest([a, b]) AS x FROM e, (VALUES (0), (1)) v(d)), {_rectangle("chip_id, label", "k")} SELECT chip_id, label, round(length, 5) AS length FROM rectangle""")
def t19_major_axis(spark, sf):
    return P.major_axis(_labels(spark, sf), ["chip_id", "label"]).withColumn("length", F.round("length", 5))


@query(f"""WITH RECURSIVE {_LAB}, d AS (SELECT chip_id, label, sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5)) AS d, row, col, cond FROM lab), c AS (SELECT *, sum(greatest(cond, 0) * 400) OVER (PARTITION BY chip_id, label ORDER BY d, row, col ROWS UNBOUNDED PRECEDING) AS m FROM d)
SELECT chip_id, label, round(max(2.5 / (d * 20) * m * 57.75286) FILTER (d BETWEEN 1 AND 4), 5) AS rate FROM c GROUP BY ALL""")
def t20_circle_distance(spark, sf):
    found = P.circle_distance_rate(_labelled(spark, sf), ["chip_id", "label"], "cond", SIDE, 20.0, 2.5, 1.0, 4.0)
    return found.withColumn("rate", F.round("rate", 5))


@query(f"WITH RECURSIVE {_LAB} SELECT chip_id, row, col, round(cond * prob / max(prob) OVER (PARTITION BY chip_id, label), 6) AS rescaled FROM lab")
def t21_rescaled_retrieval(spark, sf):
    found = P.rescaled_retrieval(_labelled(spark, sf), ["chip_id"], "cond", "prob")
    return found.select("chip_id", "row", "col", F.round("rescaled", 6).alias("rescaled"))


_WSQL = f"{WIND}, w AS (SELECT station AS chip_id, avg(sqrt(u * u + v * v)) AS speed, degrees(atan2(avg(u), avg(v))) AS direction FROM wind GROUP BY 1)"
_RATES = ", ".join(f"greatest(0.33 * ln(speed * {f} + 1e-16) + 0.45, {floor}) / nullif(length, 0) * ime * 57.75286 AS {n}" for n, f, floor in (("q", 1.0, 0.01), ("q_high", 1.1, 0.011), ("q_low", 0.9, 0.009)))
_FEATURES = f"""f AS (SELECT chip_id, label, count(*) AS area, min(row) AS r0, min(col) AS c0, max(row) + 1 AS r1, max(col) + 1 AS c1, max(prob) * 10 AS likelihood, 500000 + (arg_max(col, (prob, -row, -col)) + 0.5) * 20 AS x, 4000000 - (arg_max(row, (prob, -row, -col)) + 0.5) * 20 AS y,
sqrt(count(*) FILTER (cond > 0) * 400.0::DOUBLE) AS length, coalesce(sum(cond) FILTER (cond > 0), 0) * 400.0::DOUBLE AS ime FROM lab GROUP BY ALL), q AS (SELECT f.*, direction, {_RATES} FROM f LEFT JOIN w USING (chip_id))"""


def _features(spark, sf):
    """Components with their features, rates and the wind's direction."""
    found = P.plume_features(_labelled(spark, sf), ["chip_id"], "cond", "prob", 20.0, 500000.0, 4000000.0)
    blowing = wind(spark, sf).groupBy(F.col("station").alias("chip_id")).agg(F.avg(S.wind_speed("u", "v")).alias("speed"), S.wind_direction(F.avg("u"), F.avg("v")).alias("direction"))
    joined = found.join(blowing, "chip_id", "left").withColumn("w", S.effective_wind("speed", *S.error_bounds("speed", 0.1)))
    rates = {n: S.emission_rate(F.col("w")[k], "length", "ime") for n, k in (("q", "eff"), ("q_high", "high"), ("q_low", "low"))}
    return joined.withColumns(rates).drop("w")


def _first(rows):
    """The component of the least label of each chip."""
    return rows.groupBy("chip_id").agg(F.min(F.struct("label", "area", "q", "q_high", "q_low")).alias("f")).select("chip_id", "f.*")


@query(f"WITH RECURSIVE {_LAB}, {_WSQL}, {_FEATURES} SELECT chip_id, label, round(likelihood, 6) AS likelihood, r0, c0, r1, c1, x, y, round(direction, 6) AS direction, round(q, 4) AS q, round(q_high, 4) AS q_high, round(q_low, 4) AS q_low FROM q")
def t22_quantify_plumes(spark, sf):
    found = _features(spark, sf)
    return found.select("chip_id", "label", F.round("likelihood", 6).alias("likelihood"), "r0", "c0", "r1", "c1", "x", "y", F.round("direction", 6).alias("direction"), *[F.round(n, 4).alias(n) for n in ("q", "q_high", "q_low")])


@query(f"""WITH RECURSIVE {_LAB}, {_WSQL}, {_FEATURES}, s AS (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY label) AS k FROM q WHERE r0 < 6 AND r1 > 2 AND c0 < 6 AND c1 > 2)
SELECT c.chip_id, coalesce(label, 0) AS label, coalesce(area, 0) AS area, {", ".join(f"round(CASE WHEN label IS NULL THEN 0 ELSE {n} END, 4) AS {n}" for n in ("q", "q_high", "q_low"))} FROM chips c LEFT JOIN s ON c.chip_id = s.chip_id AND k = 1""")
def t23_plume_at_site(spark, sf):
    from ..operators.select import overlaps_centre

    first = _first(_features(spark, sf).where(overlaps_centre(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), SIDE, 2)))
    joined = chips(spark, sf).select("chip_id").join(first, "chip_id", "left")
    rates = [F.round(F.when(F.col("label").isNull(), 0.0).otherwise(F.col(n)), 4).alias(n) for n in ("q", "q_high", "q_low")]
    return joined.select("chip_id", *rates, F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("area", F.lit(0)).alias("area"))


@query(f"""WITH RECURSIVE {_LAB}, {_WSQL}, {_FEATURES}, s AS (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY label) AS k FROM q), p AS (SELECT chip_id, min(prob * cond) AS min_marginal, max(prob) AS max_prob, max(cond) AS max_retrieval FROM pixels GROUP BY 1)
SELECT p.chip_id, round(min_marginal, 6) AS min_marginal, round(max_prob, 6) AS max_prob, round(max_retrieval, 6) AS max_retrieval, {", ".join(f"round(CASE WHEN label IS NULL THEN 0 ELSE {n} END, 4) AS {n}" for n in ("q", "q_high", "q_low"))} FROM p LEFT JOIN s ON p.chip_id = s.chip_id AND k = 1""")
def a30_detection_table(spark, sf):
    # a chip's pixels are looked at within its row; its first plume is joined by chip
    values = chip_values(spark, sf)
    marginal = F.array_min(F.zip_with("prob", "cond", lambda p, c: p * c))
    table = values.select("chip_id", F.round(marginal, 6).alias("min_marginal"), F.round(F.array_max("prob"), 6).alias("max_prob"), F.round(F.array_max("cond"), 6).alias("max_retrieval"))
    joined = table.join(_first(_features(spark, sf)), "chip_id", "left")
    return joined.select("chip_id", "min_marginal", "max_prob", "max_retrieval", *[F.round(F.when(F.col("label").isNull(), 0.0).otherwise(F.col(n)), 4).alias(n) for n in ("q", "q_high", "q_low")])


@query(f"""WITH RECURSIVE {_LAB}, mk AS (SELECT lab.*, mask FROM lab, (VALUES ('plume'), ('core')) v(mask) WHERE mask = 'plume' OR prob >= 0.9), k AS (SELECT chip_id, mask, row, col, kind, CASE kind WHEN 'conditional' THEN cond ELSE prob * cond END AS value FROM mk, (VALUES ('conditional'), ('marginal')) v(kind)),
a AS (SELECT chip_id, mask, kind, sqrt(count(*) FILTER (value > 0) * 400.0::DOUBLE) AS length, coalesce(sum(value) FILTER (value > 0), 0) * 400.0::DOUBLE AS ime FROM k GROUP BY ALL),
e AS (SELECT chip_id, mask, row, min(col) AS a, max(col) + 1 AS b FROM mk GROUP BY ALL), o AS (SELECT chip_id, mask, row + d AS y, unnest([a, b]) AS x FROM e, (VALUES (0), (1)) v(d)), {_rectangle("chip_id, mask", "o")}, x AS (SELECT chip_id, mask, length AS axis FROM rectangle),
d AS (SELECT *, sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5)) AS d FROM k), c AS (SELECT *, sum(greatest(value, 0) * 400) OVER (PARTITION BY chip_id, mask, kind ORDER BY d, row, col ROWS UNBOUNDED PRECEDING) AS m FROM d),
i AS (SELECT chip_id, mask, kind, max(m / (d * 20)) FILTER (d BETWEEN 1 AND 4) AS circle FROM c GROUP BY ALL), u AS (SELECT a.chip_id, a.mask, a.kind, unnest(['root_area', 'major_axis', 'circle_distance']) AS method, unnest([ime / nullif(length, 0), ime / nullif(axis * 20, 0), circle]) AS unit FROM a JOIN x ON a.chip_id = x.chip_id AND a.mask = x.mask JOIN i ON a.chip_id = i.chip_id AND a.mask = i.mask AND a.kind = i.kind)
SELECT chip_id, mask, kind, method, source, round(unit * speed * 57.75286, 4) AS rate FROM u, (VALUES ('era5', 3.0::DOUBLE), ('geos', 2.0)) v(source, speed)""")
def t24_all_methods(spark, sf):
    kinds = {"conditional": F.col("cond"), "marginal": F.col("prob") * F.col("cond")}
    masks = {"plume": F.lit(True), "core": F.col("prob") >= 0.9}
    found = P.all_methods(_labelled(spark, sf), ["chip_id"], kinds, masks, {"era5": 3.0, "geos": 2.0}, SIDE, 20.0, 1.0, 4.0)
    return found.withColumn("rate", F.round("rate", 4))


_Q = "q AS (SELECT l_suppkey AS site, l_extendedprice / 100 AS q FROM lineitem), c AS (SELECT site, round(avg(q), 6) AS central FROM q WHERE q > 0 GROUP BY 1), e AS (SELECT site, ln(q) AS l FROM q WHERE q > 0 UNION ALL SELECT site, ln(central) FROM c), m AS (SELECT site, median(l) AS m FROM e GROUP BY 1), d AS (SELECT e.site, median(abs(l - m)) AS mad FROM e JOIN m USING (site) GROUP BY 1)"
_CI = "SELECT site, central, central * exp(-1.96 * 1.4826 * sqrt(mad * mad + 0.13 * 0.13 + 0.32 * 0.32)) AS low, central * exp(1.96 * 1.4826 * sqrt(mad * mad + 0.13 * 0.13 + 0.32 * 0.32)) AS high FROM c JOIN d USING (site)"


def _intervals(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), (F.col("l_extendedprice") / 100).alias("q"))
    return P.interval(rows, ["site"], "q", F.round(F.avg("q"), 6))


@query(f"WITH {_Q}, i AS ({_CI}) SELECT site, central, round(low, 5) AS low, round(high, 5) AS high FROM i")
def t25_interval(spark, sf):
    return _intervals(spark, sf).withColumns({"low": F.round("low", 5), "high": F.round("high", 5)})


@query(f"WITH {_Q}, i AS ({_CI}), {WIND}, w AS (SELECT station AS site, avg(sqrt(u * u + v * v)) AS geos, avg(abs(u)) AS era5 FROM wind GROUP BY 1) SELECT i.site, round(CASE WHEN i.site % 3 = 0 THEN era5 WHEN i.site % 3 = 1 THEN geos ELSE (era5 + geos) / 2 END, 6) AS wind, central AS q, round(low, 5) AS low, round(high, 5) AS high FROM i JOIN w USING (site) WHERE i.site % 7 <> 0")
def t26_submission(spark, sf):
    speeds = wind(spark, sf).groupBy(F.col("station").alias("site")).agg(F.avg(S.wind_speed("u", "v")).alias("geos"), F.avg(F.abs("u")).alias("era5"))
    chosen = F.when(F.col("site") % 3 == 0, F.col("era5")).when(F.col("site") % 3 == 1, F.col("geos")).otherwise((F.col("era5") + F.col("geos")) / 2)
    # a rate of -1 marks a site without a plume
    rows = _intervals(spark, sf).withColumn("q", F.when(F.col("site") % 7 == 0, -1.0).otherwise(F.col("central"))).where("q <> -1")
    return rows.join(speeds, "site").select("site", F.round(chosen, 6).alias("wind"), "q", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


# -- masks over pixels ---------------------------------------------------------------------
@query(f"WITH {PIXELS}, m AS (SELECT chip_id, row, col FROM pixels WHERE prob >= 0.9), s AS (SELECT unnest(range(-1, 2)) AS d) SELECT DISTINCT chip_id, CAST(row + a.d AS INTEGER) AS row, CAST(col + b.d AS INTEGER) AS col FROM m, s a, s b WHERE row + a.d BETWEEN 0 AND 7 AND col + b.d BETWEEN 0 AND 7")
def b8_dilation(spark, sf):
    wide = R.dilate(F.transform("prob", lambda p: p >= 0.9), SIDE)
    return chip_values(spark, sf).select("chip_id", F.explode(R.set_pixels(wide, SIDE)).alias("p")).select("chip_id", "p.row", "p.col")


@query(f"WITH {PIXELS}, m AS (SELECT chip_id, row, col FROM pixels WHERE prob >= 0.3), s AS (SELECT unnest(range(-1, 2)) AS d) SELECT chip_id, CAST(row + a.d AS INTEGER) AS row, CAST(col + b.d AS INTEGER) AS col FROM m, s a, s b GROUP BY ALL HAVING count(*) = 9")
def b8_erosion(spark, sf):
    narrow = R.erode(F.transform("prob", lambda p: p >= 0.3), SIDE)
    return chip_values(spark, sf).select("chip_id", F.explode(R.set_pixels(narrow, SIDE)).alias("p")).select("chip_id", "p.row", "p.col")


@query(f"WITH {PIXELS}, k AS (SELECT chip_id, row, col, CASE WHEN v > 0.15 THEN v ELSE 0 END AS v FROM pixels), b AS (SELECT chip_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM k WHERE v <> 0 GROUP BY 1) SELECT k.chip_id, CAST(row - r0 AS INTEGER) AS row, CAST(col - c0 AS INTEGER) AS col, round(v, 6) AS v FROM k JOIN b ON k.chip_id = b.chip_id AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
def r6_trim_border(spark, sf):
    rows = pixels(spark, sf).select("chip_id", "row", "col", F.when(F.col("v") > 0.15, F.col("v")).otherwise(0.0).alias("v"))
    return RR.trim_border(rows, ["chip_id"], "v").withColumn("v", F.round("v", 6))


@query(f"WITH {PIXELS}, r AS (SELECT chip_id, row, row_number() OVER (PARTITION BY chip_id ORDER BY row) - 1 AS nr FROM (SELECT DISTINCT chip_id, row FROM pixels WHERE v > 0.25)), c AS (SELECT chip_id, col, row_number() OVER (PARTITION BY chip_id ORDER BY col) - 1 AS nc FROM (SELECT DISTINCT chip_id, col FROM pixels WHERE v > 0.25)) SELECT chip_id, CAST(nr AS INTEGER) AS row, CAST(nc AS INTEGER) AS col, round(v, 6) AS v FROM pixels JOIN r USING (chip_id, row) JOIN c USING (chip_id, col)")
def r6_keep_signal(spark, sf):
    kept = chips(spark, sf).select("chip_id", R.keep_signal("raster", SIDE, 0.25).alias("k")).select("chip_id", "k.width", F.posexplode("k.values").alias("at", "v"))
    return kept.select("chip_id", F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"), F.round("v", 6).alias("v"))


@query(f"WITH {PIXELS} SELECT chip_id, CAST(row // 2 AS BIGINT) AS row, CAST(col // 2 AS BIGINT) AS col, round(avg(v), 6) AS v FROM pixels GROUP BY ALL")
def r8_block_mean(spark, sf):
    return RR.block_mean(pixels(spark, sf), ["chip_id"], "v", 2).withColumn("v", F.round("v", 6))


@query(f"WITH {CHIPS} SELECT chip_id, array_to_string(list_transform(raster, lambda v: CAST(CAST(round_even(v * 1000, 0) AS BIGINT) AS VARCHAR)), ' ') AS raster FROM chips")
def r9_rows_to_raster(spark, sf):
    cells = pixels(spark, sf).select("chip_id", "row", "col", F.rint(F.col("v") * 1000).cast("long").alias("v"))
    return RR.to_arrays(cells, ["chip_id"], "v", SIDE).select("chip_id", F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("raster"))


# -- insertion and placement -----------------------------------------------------------------
@query(f"WITH {BAND_PIXELS}, tab AS (SELECT range AS i, exp(-range / 400.0) AS nb FROM range(101)), e AS (SELECT px.*, nb, CAST(round_even(swir22 * nb, 0) AS DOUBLE) AS new FROM px JOIN tab ON i = CAST(least(round_even(scl * 12.5 / 1000 / 0.15 * 100, 0), 100) AS BIGINT)) SELECT chip_id, px, swir16, round(new, 1) AS swir22, round((new - swir22) / swir22, 6) AS frac FROM e WHERE swir22 > 0")
def t8_insert_enhancement(spark, sf):
    table = spark.range(101).select(F.col("id").alias("i"), F.exp(-F.col("id") / 400).alias("nb"))
    found = P.insert_enhancement(band_pixels(spark, sf), table, S.scaled_emission("scl", 12.5), 0.15, 100, "swir22")
    return found.select("chip_id", "px", "swir16", F.round("inserted", 1).alias("swir22"), F.round("frac", 6).alias("frac"))


#: Each chip wants the plumes of the two chips behind it; a plume is the corner of its chip's raster, three rows of two pixels.
_PLUMES = f"""{PIXELS}, lib AS (SELECT chip_id AS plume_id, k // 2 AS r, k % 2 AS c, CASE WHEN k = 1 AND chip_id % 2 = 1 THEN 0 ELSE 1 + round_even(1000 * abs(raster[k // 2 * 8 + k % 2 + 1]), 0) END AS mass FROM chips, (SELECT unnest(range(6)) AS k)),
tm AS (SELECT plume_id, f, r, CASE f WHEN 1 THEN 1 - c ELSE c END AS c, mass FROM lib, (VALUES (0), (1)) v(f)), size AS (SELECT plume_id, sum(mass) AS total, count(*) FILTER (mass > 0) AS px FROM lib GROUP BY 1),
want AS (SELECT a.chip_id, a.chip_id + d AS plume_id, d AS ord FROM chips a, (VALUES (1), (2)) v(d)),
cand AS (SELECT chip_id, plume_id, ord, row, col, row * 8 + col AS place, x * x % 2147483647 AS key FROM (SELECT want.*, row, col, ((chip_id * 16807 + plume_id * 69621) % 2147483647 + 48271 * (row * 8 + col + 1)) % 2147483647 AS x FROM want JOIN pixels USING (chip_id)))"""
_BY_SOURCE = f"""{_PLUMES}, src AS (SELECT plume_id, f, r, c FROM tm QUALIFY row_number() OVER (PARTITION BY plume_id, f ORDER BY mass DESC, r, c) = 1), off AS (SELECT plume_id, f, tm.r - s.r AS dr, tm.c - s.c AS dc, mass FROM tm JOIN src s USING (plume_id, f) WHERE mass > 0),
sh AS (SELECT c.chip_id, c.plume_id, place, key, c.row + dr AS row, c.col + dc AS col, mass FROM cand c JOIN pixels p ON p.chip_id = c.chip_id AND p.row = c.row AND p.col = c.col AND p.prob < 0.6 JOIN off o ON o.plume_id = c.plume_id AND o.f = c.key % 2),
ok AS (SELECT sh.chip_id, sh.plume_id, place, key FROM sh JOIN size USING (plume_id) LEFT JOIN pixels p ON p.chip_id = sh.chip_id AND p.row = sh.row AND p.col = sh.col GROUP BY ALL HAVING sum(mass) FILTER (prob < 0.6) / any_value(total) >= 0.8),
fst AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY chip_id, plume_id ORDER BY key, place) = 1),
placed AS (SELECT sh.chip_id, sh.plume_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(mass AS DOUBLE) AS mass FROM sh JOIN fst USING (chip_id, plume_id, place) WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7)"""
_LIMITED = f"""{_PLUMES}, lims(lim) AS (VALUES (0.075::DOUBLE), (0.125), (0.185), (0.255), (0.335)), roomy AS (SELECT chip_id FROM pixels GROUP BY 1 HAVING count(*) FILTER (prob < 0.6) > 6),
box AS (SELECT c.chip_id, c.plume_id, ord, place, key, c.row, c.col, greatest(count(*) FILTER (prob >= 0.6), count(*) FILTER (cond < -0.2)) AS worst FROM cand c JOIN roomy USING (chip_id) JOIN pixels p ON p.chip_id = c.chip_id AND p.row BETWEEN c.row AND c.row + 2 AND p.col BETWEEN c.col AND c.col + 1 WHERE c.row <= 5 AND c.col <= 6 GROUP BY ALL),
fit AS (SELECT box.*, px, lim FROM box JOIN size USING (plume_id) JOIN lims ON worst <= lim * px), p1 AS (SELECT * FROM fit WHERE ord = 1 QUALIFY row_number() OVER (PARTITION BY chip_id ORDER BY lim, key, place) = 1),
taken AS (SELECT chip_id, row + r AS row, col + c AS col FROM p1 JOIN tm ON tm.plume_id = p1.plume_id AND f = key % 2 WHERE mass > 0),
hit AS (SELECT DISTINCT box.chip_id, place FROM box JOIN taken t ON t.chip_id = box.chip_id AND t.row BETWEEN box.row AND box.row + 2 AND t.col BETWEEN box.col AND box.col + 1 WHERE ord = 2),
p2 AS (SELECT fit.* FROM fit ANTI JOIN hit USING (chip_id, place) WHERE ord = 2 QUALIFY row_number() OVER (PARTITION BY chip_id ORDER BY lim, key, place) = 1), placed AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


def _with_plumes(spark, sf):
    """Chips with their values, and the plumes that they want."""
    place = lambda k: F.rint(1000 * F.abs(F.element_at("raster", k // 2 * 8 + k % 2 + 1))) + 1
    masses = [F.when(F.col("vec_id") % 2 == 1, 0.0).otherwise(place(k)) if k == 1 else place(k) for k in range(6)]
    library = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("raster")).select(F.col("vec_id").alias("plume_id"), F.lit(3).alias("height"), F.lit(2).alias("width"), F.array(*masses).alias("values"))
    values = chip_values(spark, sf)
    wanted = values.select("chip_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("order")).withColumn("plume_id", F.col("chip_id") + F.col("order"))
    return PL.with_plumes(values, wanted.withColumn("seed", F.col("chip_id") * 16807 + F.col("plume_id") * 69621), library, ["chip_id"])


def _by_source(spark, sf):
    chips_ = _with_plumes(spark, sf)
    return PL.placed_pixels(PL.place_by_source(chips_, F.transform("prob", lambda p: p >= 0.6), F.transform("prob", lambda p: F.lit(False)), SIDE), ["chip_id"], SIDE)


def _limited(spark, sf):
    return PL.place_within_limits(_with_plumes(spark, sf), F.transform("prob", lambda p: p >= 0.6), F.transform("cond", lambda c: c < -0.2), SIDE)


@query(f"WITH {_BY_SOURCE} SELECT chip_id, plume_id, row, col, mass FROM placed")
def t9_place_plumes(spark, sf):
    return _by_source(spark, sf)


@query(f"WITH {_LIMITED} SELECT chip_id, plume_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, key % 2 = 1 AS flipped, round(worst / px, 9) AS share, lim AS allowed FROM placed")
def t10_placement_validity(spark, sf):
    found = _limited(spark, sf).select("chip_id", F.explode("placed").alias("p")).select("chip_id", "p.*")
    return found.select("chip_id", "plume_id", "row", "col", "flipped", F.round("share", 9).alias("share"), "allowed")


@query(f"WITH {_BY_SOURCE} SELECT chip_id, row, col, sum(mass) AS mass, array_to_string(list(DISTINCT plume_id ORDER BY plume_id), ' ') AS plumes FROM placed GROUP BY ALL")
def t11_overlay(spark, sf):
    return P.overlay(_by_source(spark, sf), ["chip_id"]).withColumn("plumes", F.array_join(F.transform("plumes", lambda p: p.cast("string")), " "))


@query(f"""WITH {_LIMITED}, s AS (SELECT chip_id, count(*) AS inserted, array_to_string(list(px ORDER BY ord), ' ') AS sizes FROM placed GROUP BY 1)
SELECT p.chip_id, min(v) AS min_frac, round(sum(abs(v)), 6) AS frac_abs_sum, count(*) FILTER (abs(v) > 0.001) AS size, CAST(2 AS BIGINT) AS wanted, coalesce(any_value(inserted), 0) AS inserted, coalesce(any_value(sizes), '') AS plume_sizes FROM pixels p LEFT JOIN s ON s.chip_id = p.chip_id GROUP BY p.chip_id""")
def a11_plume_summary(spark, sf):
    placed = _limited(spark, sf).join(chips(spark, sf).select("chip_id", "raster"), "chip_id")
    return PL.plume_summary(placed, "raster").select("chip_id", "min_frac", F.round("frac_abs_sum", 6).alias("frac_abs_sum"), "size", "wanted", "inserted", F.array_join("plume_sizes", " ").alias("plume_sizes"))
