"""Baseline plume detectors: fractional differences of bands, passes, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_frac
from .interp import SMALL_CURVE, KnotIndex


def _relative(a: Column, b: Column) -> Column:
    """(a - b) / b, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(a - b, b), F.lit(0.0))


def baseline_detectors(pixels: DataFrame, keys: list[str], b11: str, b12: str, b11_ref: str, b12_ref: str, lookup: DataFrame | None = None) -> DataFrame:
    """``pixels`` with sbmp, mbsp, mbmp and zero, each cut to the range of the lookup table.

    sbmp: target B12 against reference B12, times the image's median ratio of both; mbsp: the target's relative B12 to B11;
    mbmp: the target's against the reference's, likewise weighted; zero: none anywhere. The two medians of an image
    (``keys``) come from one aggregate. Null bands count as no difference. With ``lookup`` (columns frac and value, up to
    ``SMALL_CURVE`` rows) each but zero becomes the table's value at it, between its entries and clamped to its ends; below the floor
    it is first set to the table's value there.
    """
    rows = pixels.withColumns({"_t": _relative(F.col(b12), F.col(b11)), "_r": _relative(F.col(b12_ref), F.col(b11_ref))})
    # ratios to nine digits, so that a median of two equal ones is that one whatever the order
    ratio = F.round(F.try_divide("_t", "_r"), 9)
    weights = rows.groupBy(*keys).agg(F.coalesce(F.median(F.try_divide(b12, b12_ref)), F.lit(0.0)).alias("_c"), F.coalesce(F.median(ratio), F.lit(0.0)).alias("_m"))
    found = rows.join(weights, keys)
    values = {"sbmp": _relative(F.col(b12), F.col("_c") * F.col(b12_ref)), "mbsp": F.col("_t"), "mbmp": _relative(F.col("_t"), F.col("_m") * F.col("_r"))}
    found = found.withColumns({k: clip_frac(v, lookup is not None) for k, v in values.items()})
    if lookup is not None:
        index = _lookup_index(lookup)
        for k in values:
            found = index.value(found, k, k)
    return found.withColumn("zero", F.lit(0.0)).drop("_t", "_r", "_c", "_m")


def _lookup_index(lookup: DataFrame) -> KnotIndex:
    knots = lookup.where("frac IS NOT NULL").select(F.col("frac").cast("double"), F.col("value").cast("double")).limit(SMALL_CURVE + 1).collect()
    if not 0 < len(knots) <= SMALL_CURVE:
        raise ValueError(f"a lookup table has 1 to {SMALL_CURVE} entries")
    return KnotIndex([(r[0], r[1]) for r in knots])


def pairwise_changes(rows: DataFrame, keys: list[str], order: str, raster: str, adjusted: bool = True) -> DataFrame:
    """The difference of each pair of rasters of a series, the newer one minus the older one: keys, newer, older (their ``order``),
    change; ``adjusted`` to a mean of 0. Rasters of one order aren't paired; nulls stay null, also where one raster is shorter.

    The pairs are the result, so the join is one on the keys, which adaptive execution can split where a series is long.
    """
    a = rows.select(*keys, F.col(order).alias("newer"), F.col(raster).alias("_a"))
    b = rows.select(*keys, F.col(order).alias("older"), F.col(raster).alias("_b"))
    change = a.join(b, keys).where("newer > older").withColumn("change", F.zip_with("_a", "_b", lambda x, y: x.cast("double") - y))
    if adjusted:
        known = F.filter("change", lambda x: x.isNotNull())
        change = change.withColumn("_mean", F.try_divide(F.aggregate(known, F.lit(0.0), lambda total, x: total + x), F.size(known)))
        change = change.withColumn("change", F.transform("change", lambda x: x - F.col("_mean")))
    return change.select(*keys, "newer", "older", "change")
