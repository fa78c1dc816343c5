"""Scalar expressions (Column -> Column). Undefined results are null, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physics limits, thresholds and conversion factors of the methane workflow.
FRAC_FLOOR = -0.7715
FRAC_FLOOR_LOOKUP = -0.6149
STRONG, MEDIUM, WEAK = -0.04, -0.025, -0.001
MOL_PER_PPM_M = 1e-6 * 1.2250 / 0.0289644  # air density at the ground over its molar mass
EMISSION_FACTOR = 57.75286
HARMONISE_FROM = "2022-01-25 00:00:00"
#: Scene classes: no data, saturated, dark, shadow, water and unclassified; clouds.
EXCLUDED_CLASSES, CLOUD_CLASSES = (0, 1, 2, 3, 6, 7), (8, 9)
#: Landsat QA labels: bits set (single flags, then two-bit confidences).
QA = {
    "FILL": 1, "DILATED_CLOUD": 2, "CIRRUS": 4, "CLOUD": 8, "CLOUD_SHADOW": 16, "SNOW": 32, "CLEAR": 64, "WATER": 128,
    "CLOUD_LOW": 256, "CLOUD_MEDIUM": 512, "CLOUD_HIGH": 768, "SHADOW_LOW": 1024, "SHADOW_MEDIUM": 2048, "SHADOW_HIGH": 3072,
    "SNOW_LOW": 4096, "SNOW_MEDIUM": 8192, "SNOW_HIGH": 12288, "CIRRUS_LOW": 16384, "CIRRUS_MEDIUM": 32768, "CIRRUS_HIGH": 49152,
}
QA_CLOUD = ("CLOUD", "DILATED_CLOUD", "CIRRUS", "CLOUD_MEDIUM", "CLOUD_HIGH", "CIRRUS_MEDIUM", "CIRRUS_HIGH")
QA_SHADOW = ("CLOUD_SHADOW", "SHADOW_MEDIUM", "SHADOW_HIGH")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(_c(x)), _c(x))


# -- identifiers ------------------------------------------------------------------------
# The public naming conventions of the two products.
LANDSAT_ID = r"^(L[CEOTM])(\d{2})_(L1[GTPS]{2})_(\d{3})(\d{3})_(\d{8})_(\d{8})_(\d{2})_(RT|T1|T2)$"
LANDSAT_FIELDS = ("satellite", "sensor", "level", "path", "row", "acquired", "processed", "collection", "category")
EMIT_ID = r"^EMIT_(L[12][A-Z])_([A-Z]+)_(\d{3})_(\d{8})T(\d{6})_(\d{7})_(\d{3})$"
EMIT_FIELDS = ("level", "product", "version", "date", "time", "orbit", "scene")


def parse_id(x: Column | str, pattern: str, fields: tuple[str, ...], strict: bool = False) -> Column:
    """A struct of the pattern's groups; null (or an error, if ``strict``) where it doesn't match."""
    parts = F.struct(*[F.regexp_extract(_c(x), pattern, i + 1).alias(f) for i, f in enumerate(fields)])
    return F.when(_c(x).rlike(pattern), parts).otherwise(F.raise_error(F.concat(F.lit("not an id: "), _c(x))) if strict else F.lit(None))


def product_uri(base: Column | str, *parts: Column | str, suffix: str = "") -> Column:
    """Parts joined by '/' behind a base."""
    return F.concat(F.concat_ws("/", _c(base), *[_c(p) for p in parts]), F.lit(suffix))


def id_date(x: Column | str, at: int = 2) -> Column:
    """The date in the ``at``-th '_' part of an id (from 0)."""
    return F.try_to_timestamp(F.substring(F.get(F.split(_c(x), "_"), at), 1, 8), F.lit("yyyyMMdd")).cast("date")


def padded_tile(x: Column | str) -> Column:
    """Five characters, zeros in front."""
    return F.lpad(_c(x), 5, "0")


def tile_from_name(x: Column | str) -> Column:
    """The tile in a name like T31ABC_..., without the T."""
    return F.regexp_replace(F.split_part(_c(x), F.lit("_"), F.lit(1)), "^T", "")


def sensor_letter(x: Column | str) -> Column:
    """The last character of the first '_' part (S2A_... gives A)."""
    return F.right(F.split_part(_c(x), F.lit("_"), F.lit(1)), F.lit(1))


def prefixed_format(x: Column | str, old: str, new: str) -> Column:
    """The last part of a path with another extension."""
    return F.concat(F.regexp_extract(_c(x), rf"([^/]+){old}$", 1), F.lit(new))


def bands_valid(bands: Column | str, needed: tuple[str, ...], banned: tuple[str, ...] = ()) -> Column:
    """All needed bands are there and no banned one."""
    have = _c(bands)
    return (F.size(F.array_except(F.array(*[F.lit(b) for b in needed]), have)) == 0) & ~F.arrays_overlap(have, F.array(*[F.lit(b) for b in banned or ("",)]))


def number_or_null(x: Column | str, word: str = "null") -> Column:
    """A number, or null for the word and whatever isn't a number."""
    return F.nullif(_c(x), F.lit(word)).try_cast("double")


# -- dates --------------------------------------------------------------------------------
#: Formats of dates in scene lists, in the order in which they are tried; months and days of one or two digits.
DATE_FORMATS = ("yyyy/M/d", "yyyy-M-d")


def date_by(x: Column | str, form: str) -> Column:
    """A date by one format, null where it doesn't fit."""
    return F.try_to_timestamp(_c(x), F.lit(form)).cast("date")


def season(x: Column | str) -> Column:
    month = F.month(_c(x))
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def _micros(x: Column | str) -> Column:
    return F.unix_micros(_c(x).cast("timestamp"))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (_micros(end) - _micros(start)) / 60e6


def at_time(date: Column | str, time: Column | str) -> Column:
    """A timestamp of a date and a time of day, both text."""
    return F.try_to_timestamp(F.concat_ws(" ", _c(date), _c(time)), F.lit("yyyy-MM-dd HH:mm:ss"))


def days_apart(a: Column | str, b: Column | str) -> Column:
    """Whole days from a to b, rounded down, signed."""
    return F.floor((_micros(b) - _micros(a)) / 86400e6)


# -- pixels -------------------------------------------------------------------------------
def frac(swir22: str, swir22_ref: str, swir16: str, swir16_ref: str) -> Column:
    """(s22 / s22ref) / (s16 / s16ref) - 1."""
    return F.try_divide(F.try_divide(_c(swir22), _c(swir22_ref)), F.try_divide(_c(swir16), _c(swir16_ref))) - 1


def band_ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a), _c(b))


def range_mean(wavelengths: Column | str, values: Column | str, low: float, high: float) -> Column:
    """The mean of the values whose wavelength is in [low, high]; an error if the range holds none."""
    pairs = F.filter(F.arrays_zip(_c(wavelengths).alias("w"), _c(values).alias("v")), lambda p: p["w"].between(low, high))
    mean = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["v"]) / F.size(pairs)
    return F.when(F.size(pairs) == 0, F.raise_error(F.lit(f"no band between {low} and {high}")).cast("double")).otherwise(mean)


def swir_ratio(wavelengths: Column | str, values: Column | str, absorbing: tuple[float, float], plain: tuple[float, float]) -> Column:
    """The band ratio of a sensor of many narrow bands: means over the range that methane absorbs in and over one that it doesn't."""
    return F.try_divide(range_mean(wavelengths, values, *absorbing), range_mean(wavelengths, values, *plain))


def multi_band_ratio(b12: Column | str, b11: Column | str) -> Column:
    """(B12 - B11) / B11, 0 where undefined."""
    return F.coalesce(F.try_divide(_c(b12) - _c(b11), _c(b11)), F.lit(0.0))


def fractional_difference(main: Column | str, reference: Column | str) -> Column:
    """(main - reference) / reference, 0 where undefined."""
    return F.coalesce(F.try_divide(_c(main) - _c(reference), _c(reference)), F.lit(0.0))


def clip_frac(x: Column | str, lookup: bool = False) -> Column:
    """Into what methane can do: at most 0; below the floor it is the floor, or with a lookup table that table's value there."""
    return F.when(_c(x) > 0, 0.0).when(_c(x) < FRAC_FLOOR, FRAC_FLOOR_LOOKUP if lookup else FRAC_FLOOR).otherwise(_c(x))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def marginal(probability: Column | str, conditional: Column | str) -> Column:
    return _c(probability) * _c(conditional)


def bce_with_logits(x: Column | str, y: Column | str) -> Column:
    """Binary cross-entropy of a logit, stable for large ones."""
    return F.greatest(_c(x), F.lit(0.0)) - _c(x) * _c(y) + F.log1p(F.exp(-F.abs(_c(x))))


def modulated(band: Column | str, original: Column | str, m: Column | float) -> Column:
    """band**m * original**(1 - m), rounded half to even."""
    m = F.lit(m) if isinstance(m, float) else m
    return F.rint(F.pow(_c(band), m) * F.pow(_c(original), 1 - m))


def modulated_frac(x: Column | str, m: float) -> Column:
    return F.pow(1 + _c(x), F.lit(m)) - 1


def reflectance(x: Column | str, scale: float = 1e-4) -> Column:
    return _c(x) * scale


def harmonised(x: Column | str, acquired: Column | str, since: str = HARMONISE_FROM) -> Column:
    """Newer products without their offset of 1000."""
    return F.when(_c(acquired) >= F.lit(since).cast("timestamp"), F.greatest(_c(x), F.lit(1000)) - 1000).otherwise(_c(x))


def toa_reflectance(dn: Column | str, gain: float, bias: float, sun_zenith: Column | float) -> Column:
    """Digital numbers to 10000 * reflectance: 1 where not positive, at most 65535, half to even; no data (0) stays 0."""
    zenith = sun_zenith if isinstance(sun_zenith, Column) else F.lit(sun_zenith)
    value = (_c(dn) * gain + bias) / F.cos(F.radians(zenith)) * 10000
    return F.rint(F.when(_c(dn) == 0, 0.0).when(value <= 0, 1.0).otherwise(F.least(value, F.lit(65535.0))))


def brightness_temperature(dn: Column | str, gain: float, bias: float, k1: float, k2: float) -> Column:
    """Digital numbers to 10 * kelvin, at most 65535, half to even; no data stays 0."""
    value = 10 * k2 / F.ln(F.lit(k1) / (_c(dn) * gain + bias) + 1)
    return F.rint(F.when(_c(dn) == 0, 0.0).otherwise(F.least(value, F.lit(65535.0))))


def ppm_m_to_mol_m2(x: Column | str) -> Column:
    return _c(x) * MOL_PER_PPM_M


def mol_m2_to_ppb(x: Column | str, air_column: float = 356_624.0) -> Column:
    """Methane column over the dry-air column, in parts per billion."""
    return _c(x) / air_column * 1e9


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.hypot(_c(u), _c(v))


def wind_direction(u: Column | str, v: Column | str) -> Column:
    """degrees(atan2(u, v)): 0 north, 90 east, -90 west."""
    return F.degrees(F.atan2(_c(u), _c(v)))


def compass(direction: Column | str) -> Column:
    return F.pmod(_c(direction), F.lit(360.0))


def error_bounds(x: Column | str, share: float) -> tuple[Column, Column]:
    return _c(x) * (1 - share), _c(x) * (1 + share)


def effective_wind(speed: Column | str, low: Column | str, high: Column | str) -> Column:
    """0.33 ln(w) + 0.45 of a speed and its bounds, each with a floor of its own: a struct of eff, high, low."""

    def eff(w: Column | str, floor: float) -> Column:
        return F.greatest(0.33 * F.ln(_c(w) + 1e-16) + 0.45, F.lit(floor))

    return F.struct(eff(speed, 0.01).alias("eff"), eff(high, 0.011).alias("high"), eff(low, 0.009).alias("low"))


def gamma(sun_zenith: Column | str, view_zenith: Column | str) -> Column:
    """1 / cos(sun) + 1 / cos(view); an error outside 0 to 90 degrees."""
    good = _c(sun_zenith).between(0, 90) & _c(view_zenith).between(0, 90)
    value = 1 / F.cos(F.radians(_c(sun_zenith))) + 1 / F.cos(F.radians(_c(view_zenith)))
    return F.when(good, value).otherwise(F.raise_error(F.lit("angles must be in 0 to 90 degrees")).cast("double"))


def plume_category(min_frac: Column | str) -> Column:
    x = _c(min_frac)
    return F.when(x < STRONG, "strong").when(x < MEDIUM, "medium").when(x < WEAK, "weak").otherwise("no")


def attenuated(x: Column | str, offset: float, factor: float) -> Column:
    """(x + offset) * factor, at least 0, rounded half to even."""
    return F.rint(F.greatest((_c(x) + offset) * factor, F.lit(0.0)))


def scaled_emission(x: Column | str, rate: Column | float) -> Column:
    return _c(x) * (rate if isinstance(rate, Column) else F.lit(rate)) / 1000


def to_uint8(probability: Column | str) -> Column:
    return F.rint(_c(probability) * 255).cast("smallint")


def combined_frac(a: Column | str, b: Column | str) -> Column:
    return 1 - (1 - _c(a)) * (1 - _c(b))


def emission_rate(wind: Column | str, length: Column | str, ime: Column | str) -> Column:
    """wind / length * IME * factor, in kg/h."""
    return F.try_divide(_c(wind), _c(length)) * _c(ime) * EMISSION_FACTOR


def string_seed(x: Column | str) -> Column:
    """sha256 of a text modulo 2**32."""
    return F.conv(F.right(F.sha2(_c(x).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")


def uniform(x: Column | str) -> Column:
    """A number in [0, 1) by the text's hash."""
    return string_seed(x) / F.lit(float(1 << 32))


# -- masks --------------------------------------------------------------------------------
def qa_any(qa: Column | str, *labels: str) -> Column:
    """All bits of any of the labels are set."""
    out = F.lit(False)
    for label in labels:
        out = out | (_c(qa).bitwiseAND(F.lit(QA[label])) == QA[label])
    return out


def s2_cloud(scl: Column | str, thin: Column | str, thick: Column | str) -> Column:
    return (_c(thin) + _c(thick) > 35) | _c(scl).isin(*CLOUD_CLASSES)


def s2_shadow(shadow: Column | str, cloud: Column) -> Column:
    return (_c(shadow) > 30) & ~cloud


def landsat_cloud(qa: Column | str) -> Column:
    return qa_any(qa, *QA_CLOUD) & ~qa_any(qa, "FILL")


def landsat_shadow(qa: Column | str) -> Column:
    """Shadow where no cloud flag and no fill is set."""
    return qa_any(qa, *QA_SHADOW) & ~qa_any(qa, *QA_CLOUD) & ~qa_any(qa, "FILL")


def s2_excluded(scl: Column | str, cloud: Column, shadow: Column) -> Column:
    return cloud | shadow | _c(scl).isin(*EXCLUDED_CLASSES)


def landsat_excluded(qa: Column | str) -> Column:
    return landsat_cloud(qa) | landsat_shadow(qa) | qa_any(qa, "FILL", "WATER")


def no_data(bands: Column | str) -> Column:
    """Any band is 0."""
    return F.exists(_c(bands), lambda x: x == 0)


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Between two knots; the left one's value where they coincide."""
    return y0 + F.coalesce(F.try_divide((x - x0) * (y1 - y0), x1 - x0), F.lit(0.0))


DEGREES_PER_KM = 1 / 111.0
PI = math.pi
