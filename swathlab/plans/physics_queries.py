"""Brightness tables, filters, cross-sections over the spectral curve and the scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import physics as H
from .bindings import CURVE, PIXELS, curve, load, pixels, query

_SPECTRA = f"{CURVE}, sp AS (SELECT wavelength, response / 2000 AS w, wavelength / 100 AS sigma FROM curve), nf AS (SELECT wavelength, sigma, w / sum(w) OVER () AS w FROM sp)"
_GAMMA = "sc AS (SELECT o_orderkey AS granule_id, 1 / cos(radians(o_custkey % 8 * 5)) + 1 / cos(radians(5)) AS gamma FROM orders)"


def _spectra(spark, sf):
    rows = curve(spark, sf).select("wavelength", (F.col("response") / 2000).alias("w"), (F.col("wavelength") / 100).alias("sigma"), F.lit("band").alias("band"))
    return H.normalised(rows, "band", "w")


@query(f"WITH {_SPECTRA}, {_GAMMA}, g AS (SELECT DISTINCT gamma FROM sc), c AS (SELECT CAST(unnest(range(0, 21, 4)) AS DOUBLE) AS conc), t AS (SELECT gamma, conc, sum(w * exp(-gamma * conc * sigma)) AS nb FROM nf, g, c GROUP BY ALL) SELECT granule_id, conc, round(nb, 9) AS nb FROM sc JOIN t USING (gamma)")
def t1_brightness_table(spark, sf):
    angles = load(spark, sf, "orders").select(F.col("o_orderkey").alias("granule_id"), S.gamma(F.col("o_custkey") % 8 * 5, F.lit(5)).alias("gamma"))
    conc = spark.range(6).select((F.col("id") * 4).cast("double").alias("conc"))
    return H.brightness_table(_spectra(spark, sf), angles, conc, "sigma", "w", "gamma", "wavelength", "granule_id").withColumn("nb", F.round("nb", 9))


@query("WITH p AS (SELECT p_size AS wavelength, p_brand AS band, avg(p_retailprice / 1000) AS srf FROM part GROUP BY ALL), g AS (SELECT band, wavelength, srf * (1 + wavelength / 100.0) * pow(wavelength / 60.0, 2.5) AS f FROM p) SELECT band, wavelength, round(f / sum(f) OVER (PARTITION BY band), 9) AS f FROM g")
def t2_filter_algebra(spark, sf):
    srf = load(spark, sf, "part").groupBy(F.col("p_size").alias("wavelength"), F.col("p_brand").alias("band")).agg(F.avg(F.col("p_retailprice") / 1000).alias("srf"))
    product = srf.select("band", "wavelength", (F.col("srf") * (1 + F.col("wavelength") / 100) * F.pow(F.col("wavelength") / 60, F.lit(2.5))).alias("f"))
    return H.normalised(product, "band", "f").select("band", "wavelength", F.round("f", 9).alias("f"))


@query("""WITH p AS (SELECT p_brand AS band, p_size AS wavelength, avg(p_retailprice / 1000) AS srf FROM part GROUP BY ALL), g(gamma) AS (VALUES (2.0::DOUBLE), (2.5)),
f AS (SELECT gamma, band, wavelength, srf * (1 + wavelength / 100.0) * pow(exp(-0.3 * wavelength / 60.0) * exp(-0.2 * srf) * exp(-0.5 * (60 - wavelength) / 60.0), gamma) AS f FROM p, g) SELECT gamma, band, wavelength, round(f / sum(f) OVER (PARTITION BY gamma, band), 9) AS f FROM f""")
def t2_global_filter(spark, sf):
    srf = load(spark, sf, "part").groupBy(F.col("p_brand").alias("band"), F.col("p_size").alias("wavelength")).agg(F.avg(F.col("p_retailprice") / 1000).alias("f"))
    solar = srf.withColumn("f", 1 + F.col("wavelength") / 100)
    species = [(srf.withColumn("f", F.col("wavelength") / 60), 0.3), (srf, 0.2), (srf.withColumn("f", (60 - F.col("wavelength")) / 60), 0.5)]
    found = H.global_filter(srf, solar, [H.absorbing_filter(s, "f", amount) for s, amount in species], [2.0, 2.5], "band", "wavelength", "f")
    return found.withColumn("f", F.round("f", 9))


@query("""WITH g AS (SELECT p_size AS wavelength, CAST(CASE p_partkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 1000 END AS DOUBLE) AS p, CAST(p_partkey % 4 * 50 + 150 AS DOUBLE) AS t, round(avg(p_retailprice), 6) AS sigma FROM part GROUP BY ALL),
c AS (SELECT wavelength, p, t, sigma, (CASE p WHEN 500 THEN 0.6 WHEN 1000 THEN 0.4 ELSE 0 END) * (CASE t WHEN 250 THEN 0.74 WHEN 300 THEN 0.26 ELSE 0 END) AS w FROM g) SELECT wavelength, round(sum(sigma * w), 6) AS sigma FROM c GROUP BY 1""")
def t4_cross_section(spark, sf):
    pressure = F.when(F.col("p_partkey") % 3 == 0, 200.0).when(F.col("p_partkey") % 3 == 1, 500.0).otherwise(1000.0)
    grid = load(spark, sf, "part").groupBy(F.col("p_size").alias("wavelength"), pressure.alias("p"), (F.col("p_partkey") % 4 * 50 + 150).cast("double").alias("t")).agg(F.round(F.avg("p_retailprice"), 6).alias("sigma"))
    return H.cross_section(grid, "wavelength", 700.0, 263.0).withColumn("sigma", F.round("sigma", 6))


# the fourth band stands where nothing is absorbed
_HYPER = f"""{CURVE}, b(band, centre, width) AS (VALUES (1, 10.0::DOUBLE, 3.0::DOUBLE), (2, 25.0, 3.0), (3, 40.0, 4.0), (4, 48.0, 0.4)), gc AS (SELECT CAST(unnest(range(0, 5)) AS DOUBLE) AS gc),
x AS (SELECT band, gc, -pow((wavelength - centre) / (width / 2.354820045), 2) / 2 AS r, CASE WHEN wavelength <= 46 THEN response / 1000 ELSE 0 END AS s FROM curve, b, gc WHERE abs(wavelength - centre) <= 4 * width), h AS (SELECT band, gc, ln(sum(exp(r - gc * s))) - ln(sum(exp(r))) AS log_nb FROM x GROUP BY ALL)"""


def _hyper(spark, sf):
    bands = spark.createDataFrame([(1, 10.0, 3.0), (2, 25.0, 3.0), (3, 40.0, 4.0), (4, 48.0, 0.4)], "band int, centre double, width double")
    gc = spark.range(5).select(F.col("id").cast("double").alias("gc"))
    spectra = curve(spark, sf).select("wavelength", F.when(F.col("wavelength") <= 46, F.col("response") / 1000).otherwise(0.0).alias("sigma"))
    return H.hyperspectral_log_brightness(spectra, bands, gc)


@query(f"WITH {_HYPER} SELECT band, gc, round(log_nb, 7) + 0.0 AS log_nb FROM h")
def t7_hyperspectral_brightness(spark, sf):
    return _hyper(spark, sf).withColumn("log_nb", F.round("log_nb", 7) + 0.0)


#: Pixels without methane have a gamma * c of 0; the others one between two entries of the table.
_NB = f"""{_HYPER}, {PIXELS}, e AS (SELECT band, 1 - exp(min(log_nb)) >= 1e-5 AS sensitive FROM h WHERE gc > 0 GROUP BY 1), q AS (SELECT chip_id, row, col, cond, prob, CASE WHEN cond < -0.2 THEN 0 ELSE 1 + 3 * prob END AS gc FROM pixels),
j AS (SELECT q.*, e.band, e.sensitive, floor(q.gc) AS k, l.log_nb AS l0, u.log_nb AS l1 FROM q CROSS JOIN e LEFT JOIN h l ON l.band = e.band AND l.gc = floor(q.gc) AND q.gc > 0 LEFT JOIN h u ON u.band = e.band AND u.gc = floor(q.gc) + 1),
n AS (SELECT *, CASE WHEN gc <= 1e-5 OR NOT sensitive THEN 1 ELSE 1 - exp(ln(1 - exp(l0)) + (ln(gc) - ln(k)) / (ln(k + 1) - ln(k)) * (ln(1 - exp(l1)) - ln(1 - exp(l0)))) END AS nb FROM j)"""


def _hyper_pixels(spark, sf):
    """Pixels with the brightness of all bands (array nb)."""
    table = H.BandTable(_hyper(spark, sf))
    rows = pixels(spark, sf).withColumn("gc", F.when(F.col("cond") < -0.2, 0.0).otherwise(1 + 3 * F.col("prob")))
    return table, table.brightness(rows, "gc", "nb")


def _by_band(table, rows, columns, values):
    """A row for each band; ``values``: name to array column."""
    each = F.explode(F.arrays_zip(F.lit(table.bands).alias("band"), *[v.alias(k) for k, v in values.items()])).alias("_b")
    return rows.select(*columns, each).select(*columns, F.col("_b.band").cast("int").alias("band"), *[F.round(F.col("_b")[k], 6).alias(k) for k in values])


@query(f"WITH {_NB} SELECT chip_id, row, col, band, round(nb, 6) AS nb FROM n")
def m26_log_absorption(spark, sf):
    table, rows = _hyper_pixels(spark, sf)
    return _by_band(table, rows, ["chip_id", "row", "col"], {"nb": F.col("nb")})


@query(f"WITH {_NB} SELECT chip_id, row, col, round(prob * gc, 6) AS target, band, round(coalesce(CASE WHEN cond > -0.1 THEN cond END * nb, 0), 6) AS radiance FROM n")
def t43_insert_hyperspectral(spark, sf):
    table, rows = _hyper_pixels(spark, sf)
    original = F.when(F.col("cond") > -0.1, F.col("cond"))
    radiance = F.transform("nb", lambda nb: F.coalesce(original * nb, F.lit(0.0)))
    return _by_band(table, rows.withColumn("target", F.round(F.col("prob") * F.col("gc"), 6)), ["chip_id", "row", "col", "target"], {"radiance": radiance})
