"""Radiative-transfer tables: brightness, filters, cross-sections, lookups."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interp import KnotIndex, interpolate_curve
from .joins import aligned_curves


def forward_lookup(rows: DataFrame, table: DataFrame, concentration: Column, most: float, n: int, value: str) -> DataFrame:
    """Rows with the table's value (columns i, value; i from 0 to n) at the nearest index; below 0 the first, above the last."""
    index = F.greatest(F.least(F.rint(concentration / most * n), F.lit(float(n))), F.lit(0.0)).cast("long")
    return rows.withColumn("i", index).join(table.select("i", value), "i").drop("i")


def reverse_lookup(rows: DataFrame, table: DataFrame, frac: str, concentration: str) -> DataFrame:
    """Rows with the concentration at their frac, between the table's entries, clipped to its range."""
    return interpolate_curve(rows, table, frac, frac, concentration, concentration)


#: Rows of a grid, wavelengths by concentrations, that are broadcast; of a larger one each part is exchanged.
GRID_LIMIT = 500_000


def brightness_table(spectra: DataFrame, scenes: DataFrame, concentrations: DataFrame, sigma: str, weight: str, gamma: str, wavelength: str, scene: str) -> DataFrame:
    """nB(c) = sum over wavelengths of filter * exp(-gamma * c * sigma): scene, conc, nb. Scenes without gamma are left out.

    Sums are made once for each distinct gamma, however many scenes have it. The gammas stay where they are, and the
    grid goes to them: by broadcast up to ``GRID_LIMIT`` rows, else in parts that meet every gamma, whose sums are combined.
    """
    spark = spectra.sparkSession
    gammas = scenes.where(F.col(gamma).isNotNull()).select(gamma).distinct()
    n = spectra.count() * concentrations.count()
    parts = 1 if n <= GRID_LIMIT else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // GRID_LIMIT))
    lines = spectra.select(wavelength, F.col(sigma).alias("_s"), F.col(weight).alias("_w"))
    value = F.sum(F.col("_w") * F.exp(-F.col(gamma) * F.col("conc") * F.col("_s"))).alias("nb")
    if parts == 1:
        grid = lines.crossJoin(F.broadcast(concentrations))
        each = gammas.crossJoin(F.broadcast(grid))  # both sides counted
    else:
        part = F.pmod(F.xxhash64("conc", wavelength), F.lit(parts)).cast("int")
        grid = lines.crossJoin(concentrations).withColumn("_part", part)
        each = gammas.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(grid, "_part")
    per_gamma = each.groupBy(gamma, "conc").agg(value)
    return scenes.select(scene, gamma).join(per_gamma, gamma).select(scene, "conc", "nb")


def normalised(filters: DataFrame, band: str, value: str) -> DataFrame:
    """A filter's values over their sum in the band."""
    sums = filters.groupBy(band).agg(F.sum(value).alias("_sum"))
    return filters.join(sums, band).withColumn(value, F.try_divide(value, "_sum")).drop("_sum")


def absorbing_filter(section: DataFrame, value: str, amount: float) -> DataFrame:
    """What a species lets through: exp(-cross-section * amount), ``amount`` in molecules per area of the cross-section's unit."""
    return section.withColumn(value, F.exp(-F.col(value) * amount))


def global_filter(srf: DataFrame, solar: DataFrame, species: list[DataFrame], gammas: list[float], band: str, wavelength: str, value: str) -> DataFrame:
    """srf * solar * (product of what the species let through) ** gamma over its sum in the band: gamma, band, wavelength, value.

    All curves have band, wavelength and value on one grid, else it is an error. One exchange aligns them for any number of
    species and gammas, one more sums them.
    """
    names = [f"_species{i}" for i in range(len(species))]
    aligned = aligned_curves({"_srf": srf, "_solar": solar} | dict(zip(names, species, strict=True)), [band, wavelength], value)
    through = functools.reduce(Column.__mul__, [F.col(n) for n in names], F.lit(1.0))
    product = F.col("_srf") * F.col("_solar") * F.pow(through, F.col("gamma"))
    each = aligned.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    rows = each.select("gamma", band, wavelength, product.alias(value))
    sums = rows.groupBy("gamma", band).agg(F.sum(value).alias("_sum"))
    return rows.join(sums, ["gamma", band]).select("gamma", band, wavelength, F.try_divide(value, "_sum").alias(value))


def cross_section(table: DataFrame, wavelength: str, p: float, t: float) -> DataFrame:
    """Bilinear in pressure and temperature: wavelength, sigma. ``table``: wavelength, p, t, sigma on a full grid. An error outside the grid."""
    near = table.select("p", "t").distinct().agg(
        F.max(F.when(F.col("p") <= p, F.col("p"))).alias("p0"), F.min(F.when(F.col("p") >= p, F.col("p"))).alias("p1"),
        F.max(F.when(F.col("t") <= t, F.col("t"))).alias("t0"), F.min(F.when(F.col("t") >= t, F.col("t"))).alias("t1"),
    )
    corners = table.crossJoin(F.broadcast(near))  # one row
    outside = F.col("p0").isNull() | F.col("p1").isNull() | F.col("t0").isNull() | F.col("t1").isNull()

    def weight(x: str, low: str, high: str, at: float) -> Column:
        span = F.col(high) - F.col(low)
        upper = F.coalesce(F.try_divide(F.lit(at) - F.col(low), span), F.lit(0.0))
        return F.when(F.col(x) == F.col(low), 1 - upper).when(F.col(x) == F.col(high), upper).otherwise(0.0)

    share = weight("p", "p0", "p1", p) * weight("t", "t0", "t1", t)
    value = F.when(outside, F.raise_error(F.lit("outside the grid")).cast("double")).otherwise(F.col("sigma") * share)
    return corners.groupBy(wavelength).agg(F.sum(value).alias("sigma"))


def log_absorption(gamma_c: Column, low: Column, high: Column, y_low: Column, y_high: Column) -> Column:
    """Brightness at gamma * c: the logarithm of absorption is linear in that of gamma * c between two table entries (log-brightness ``y``)."""
    share = (F.ln(gamma_c) - F.ln(low)) / (F.ln(high) - F.ln(low))
    left, right = F.ln(-F.expm1(y_low)), F.ln(-F.expm1(y_high))
    return -F.expm1(left + share * (right - left))


def hyperspectral_log_brightness(spectra: DataFrame, bands: DataFrame, gamma_c: DataFrame) -> DataFrame:
    """ln of each band's brightness at each gamma * c, by a stable log-sum-exp over wavelengths: band, gc, log_nb.

    ``spectra``: wavelength, sigma; ``bands``: band, centre, width (full width at half maximum); ``gamma_c``: gc. Wavelengths
    beyond four widths have no part.
    """
    sd = F.col("width") / 2.354820045
    response = -F.pow((F.col("wavelength") - F.col("centre")) / sd, 2) / 2
    lines = spectra.join(F.broadcast(bands), F.abs(F.col("wavelength") - F.col("centre")) <= 4 * F.col("width")).withColumn("_r", response)
    x = F.col("_r") - F.col("gc") * F.col("sigma")
    crossed = lines.crossJoin(F.broadcast(gamma_c)).withColumn("_x", x)
    tops = crossed.groupBy("band", "gc").agg(F.max("_x").alias("_tx"), F.max("_r").alias("_tr"))
    sums = crossed.join(F.broadcast(tops), ["band", "gc"]).groupBy("band", "gc").agg(
        (F.first("_tx") + F.ln(F.sum(F.exp(F.col("_x") - F.col("_tx"))))).alias("_a"), (F.first("_tr") + F.ln(F.sum(F.exp(F.col("_r") - F.col("_tr"))))).alias("_b")
    )
    return sums.select("band", "gc", (F.col("_a") - F.col("_b")).alias("log_nb"))


#: Fixed value: gamma * c and absorption below which nothing is absorbed.
LEAST_ABSORPTION = 1e-5


class BandTable:
    """A lookup table of log-brightness, bands by gamma * c, for all bands of a pixel at once.

    The logarithm of absorption is linear in that of gamma * c between two entries, and constant beyond the ends. Bands whose
    absorption is below ``LEAST_ABSORPTION`` at all entries are insensitive: their brightness is 1, as it is at a
    gamma * c up to that value. Bands and entries are those of a sensor and a grid, so the table is a constant of the plan.
    """

    def __init__(self, table: DataFrame, band: str = "band", gamma_c: str = "gc", log_nb: str = "log_nb"):
        rows = table.where(F.col(gamma_c) > 0).select(band, F.col(gamma_c).cast("double"), F.col(log_nb).cast("double")).orderBy(band, gamma_c).collect()
        self.bands = sorted({r[0] for r in rows})
        self.grid = sorted({r[1] for r in rows})
        found = {(r[0], r[1]): r[2] for r in rows}
        if len(found) != len(self.bands) * len(self.grid):
            raise ValueError("every band needs an entry at every gamma * c")
        absorbed = [[-math.expm1(found[b, g]) for g in self.grid] for b in self.bands]
        self.sensitive = [max(a) >= LEAST_ABSORPTION for a in absorbed]
        self.logs = [[math.log(max(x, 5e-324)) for x in a] for a in absorbed]

    def brightness(self, rows: DataFrame, gamma_c: str, out: str) -> DataFrame:
        """``rows`` with an array of each band's brightness at a column of gamma * c; nulls there count as nothing absorbed."""
        index = KnotIndex([(math.log(g), float(i)) for i, g in enumerate(self.grid)])
        place = rows.withColumn("_log", F.when(F.col(gamma_c) > LEAST_ABSORPTION, F.ln(F.col(gamma_c).cast("double"))))
        at = index.value(place, "_log", "_place").withColumn("_k", F.least(F.floor("_place"), F.lit(max(0, len(self.grid) - 2))).cast("int"))
        at = at.withColumn("_share", F.col("_place") - F.col("_k"))
        logs, last = F.lit([x for a in self.logs for x in a]), len(self.grid) - 1
        values = []
        for b, sensitive in enumerate(self.sensitive):
            low, high = F.get(logs, F.col("_k") + b * (last + 1)), F.get(logs, F.least(F.col("_k") + 1, F.lit(last)) + b * (last + 1))
            values.append(F.when(F.col("_place").isNull() | F.lit(not sensitive), 1.0).otherwise(-F.expm1(low + F.col("_share") * (high - low))))
        return at.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], F.array(*values).alias(out))
