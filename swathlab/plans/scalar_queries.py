"""Scalar expressions over whole tables: identifiers, dates, pixel and wind arithmetic, masks, rasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions import scalar as S
from ..sources.io import parse_dates
from .bindings import BAND_PIXELS, CHIPS, PIXELS, SCENES, SIDE, SITES, WIND, Query, band_pixels, chips, load, pixels, query, register, scenes, sites, wind


def _columns(name: str, source: Query, cte: str, frm: str, keys: list[str], values: dict[str, tuple[Callable[[], Column], str]], digits: int | None = None) -> None:
    """A query of the keys and some expressions of every row of a table."""

    def run(spark, sf) -> DataFrame:
        made = {k: make() for k, (make, _) in values.items()}
        return source(spark, sf).select(*keys, *[(F.round(c, digits) if digits is not None else c).alias(k) for k, c in made.items()])

    sql = ", ".join(f"round({x}, {digits}) AS {k}" if digits is not None else f"{x} AS {k}" for k, (_, x) in values.items())
    register(name, run, f"{'WITH ' + cte if cte else ''} SELECT {', '.join(keys)}, {sql} FROM {frm}")


_L, _E, _O, _V, _C = ["chip_id", "px"], ["chip_id", "row", "col"], ["granule_id"], ["event_id"], ["site_id"]


def _l(name: str, values: dict, digits: int | None = 6) -> None:
    _columns(name, band_pixels, BAND_PIXELS, "px", _L, values, digits)


def _e(name: str, values: dict, digits: int | None = 6) -> None:
    _columns(name, pixels, PIXELS, "pixels", _E, values, digits)


def _v(name: str, values: dict, digits: int | None = 6) -> None:
    _columns(name, wind, WIND, "wind", _V, values, digits)


def _o(name: str, values: dict, digits: int | None = None) -> None:
    _columns(name, scenes, SCENES, "scenes", _O, values, digits)


def _c(name: str, values: dict, digits: int | None = 6) -> None:
    _columns(name, sites, SITES, "sites", _C, values, digits)


# -- math ----------------------------------------------------------------------------------
_l("m1_frac", {"frac": (lambda: S.frac("swir22", "swir22_ref", "swir16", "swir16_ref"), "(swir22 / swir22_ref) / (swir16 / swir16_ref) - 1")})
_l("m2_band_ratio", {"ratio": (lambda: S.band_ratio("swir22", "swir16"), "swir22 / swir16")})


@query(f"WITH {CHIPS} SELECT chip_id, round(list_avg(list_transform(raster[41:61], lambda v: abs(v) + 1)) / list_avg(list_transform(raster[1:21], lambda v: abs(v) + 1)), 6) AS ratio FROM chips")
def m2_hyperspectral_ratio(spark, sf):
    """A chip's values as those of 64 narrow bands, 10 nm apart from 2000 nm on."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 2000.0 + 10 * i)
    rows = chips(spark, sf).select("chip_id", F.transform("raster", lambda v: F.abs(v) + 1).alias("values"), bands.alias("bands"))
    return rows.select("chip_id", F.round(S.swir_ratio("bands", "values", (2400.0, 2600.0), (2000.0, 2200.0)), 6).alias("ratio"))


_l("m3_multi_band_ratio", {"ratio": (lambda: S.multi_band_ratio("swir22", "swir16"), "coalesce((swir22 - swir16) / nullif(swir16, 0), 0)")})
_l("m4_fractional_difference", {"difference": (lambda: S.fractional_difference("swir16", "swir16_ref"), "coalesce((swir16 - swir16_ref) / nullif(swir16_ref, 0), 0)")})
_e(
    "m5_clip_frac",
    {
        "clipped": (lambda: S.clip_frac(F.col("v") * 3), "CASE WHEN v * 3 > 0 THEN 0 WHEN v * 3 < -0.7715 THEN -0.7715 ELSE v * 3 END"),
        "looked_up": (lambda: S.clip_frac(F.col("v") * 3, lookup=True), "CASE WHEN v * 3 > 0 THEN 0 WHEN v * 3 < -0.7715 THEN -0.6149 ELSE v * 3 END"),
    },
)
_e("m8_sigmoid_marginal", {"p": (lambda: S.sigmoid(F.col("v") * 10), "1 / (1 + exp(-10 * v))"), "marginal": (lambda: S.marginal("prob", "cond"), "prob * cond")})
_e("m9_bce_with_logits", {"bce": (lambda: S.bce_with_logits("v", (F.abs("target") > 0.1).cast("double")), "greatest(v, 0) - v * CAST(abs(target) > 0.1 AS DOUBLE) + ln(1 + exp(-abs(v)))")})
_l(
    "m10_modulation",
    {
        "band": (lambda: S.modulated("swir22", "swir22_ref", 0.5), "round_even(pow(swir22, 0.5) * pow(swir22_ref, 0.5), 0)"),
        "frac": (lambda: S.modulated_frac(F.col("scl") / -24, 0.5), "pow(1 + scl / -24, 0.5) - 1"),
    },
)
_l("m11_reflectance", {"reflectance": (lambda: S.reflectance("swir16"), "swir16 * 0.0001")})
_l("m12_harmonise", {"swir16": (lambda: S.harmonised("swir16", "acquired", "2000-01-25 00:00:00"), "CASE WHEN acquired >= TIMESTAMP '2000-01-25 00:00:00' THEN greatest(swir16, 1000) - 1000 ELSE swir16 END")})
_l(
    "m13_toa_reflectance",
    {"toa": (lambda: S.toa_reflectance("qa", 2e-5, -0.1, F.col("scl") * 5.0), "round_even(CASE WHEN qa = 0 THEN 0 WHEN (qa * 2e-5 - 0.1) / cos(radians(scl * 5.0)) * 10000 <= 0 THEN 1 ELSE least((qa * 2e-5 - 0.1) / cos(radians(scl * 5.0)) * 10000, 65535) END, 0)")},
)
_l(
    "m14_brightness_temperature",
    {"kelvin10": (lambda: S.brightness_temperature("qa", 3.342e-4, 0.1, 774.8853, 1321.0789), "round_even(CASE WHEN qa = 0 THEN 0 ELSE least(10 * 1321.0789 / ln(774.8853 / (qa * 3.342e-4 + 0.1) + 1), 65535) END, 0)")},
)
_l("m15_units", {"mol_m2": (lambda: S.ppm_m_to_mol_m2("swir16"), "swir16 * (1e-6 * 1.2250 / 0.0289644)"), "ppb": (lambda: S.mol_m2_to_ppb(F.col("scl") / 100), "scl / 100 / 356624 * 1e9")})
_v(
    "m16_wind",
    {
        "speed": (lambda: S.wind_speed("u", "v"), "sqrt(u * u + v * v)"), "direction": (lambda: S.wind_direction("u", "v"), "degrees(atan2(u, v))"),
        "compass": (lambda: S.compass(S.wind_direction("u", "v")), "CASE WHEN degrees(atan2(u, v)) < 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END"),
        "low": (lambda: S.error_bounds(S.wind_speed("u", "v"), 0.1)[0], "sqrt(u * u + v * v) * 0.9"), "high": (lambda: S.error_bounds(S.wind_speed("u", "v"), 0.1)[1], "sqrt(u * u + v * v) * 1.1"),
    },
)
_v(
    "m17_effective_wind",
    {
        k: ((lambda k=k: S.effective_wind(F.hypot("u", "v"), F.hypot("u", "v") * 0.5, F.hypot("u", "v") * 1.5)[k]), f"greatest(0.33 * ln(sqrt(u * u + v * v) * {f} + 1e-16) + 0.45, {floor})")
        for k, f, floor in (("eff", 1.0, 0.01), ("high", 1.5, 0.011), ("low", 0.5, 0.009))
    },
)
_l("m18_gamma", {"gamma": (lambda: S.gamma(F.col("scl") * 5, F.col("px") * 3), "1 / cos(radians(scl * 5)) + 1 / cos(radians(px * 3))")})
_e("m23_plume_category", {"category": (lambda: S.plume_category(F.col("v") / 5), "CASE WHEN v / 5 < -0.04 THEN 'strong' WHEN v / 5 < -0.025 THEN 'medium' WHEN v / 5 < -0.001 THEN 'weak' ELSE 'no' END")}, None)
_l("m24_attenuate", {"value": (lambda: S.attenuated("swir16", -20000.0, 0.3), "round_even(greatest((swir16 - 20000) * 0.3, 0), 0)")})
_e("m25_emission_scaling", {"scaled": (lambda: S.scaled_emission("v", 250.0), "v * 250 / 1000"), "quantised": (lambda: S.to_uint8("prob").cast("int"), "CAST(round_even(prob * 255, 0) AS INTEGER)")})
_e("m28_combine_fracs", {"both": (lambda: S.combined_frac("v", "target"), "1 - (1 - v) * (1 - target)")})

# -- masks ---------------------------------------------------------------------------------
_qa = lambda *labels: "(" + " OR ".join(f"(qa & {S.QA[x]}) = {S.QA[x]}" for x in labels) + ")"
_s2_cloud = "(((chip_id % 40) + (px * 3) > 35) OR scl IN (8, 9))"
_thin, _thick, _shade = (lambda: F.col("chip_id") % 40), (lambda: F.col("px") * 3), (lambda: F.col("qa") % 60)
_l("b1_qa_bits", {"hit": (lambda: S.qa_any("qa", "CLOUD_MEDIUM", "WATER"), _qa("CLOUD_MEDIUM", "WATER"))}, None)
_l("b2_class_in_set", {"cloud": (lambda: F.col("scl").isin(*S.CLOUD_CLASSES), "scl IN (8, 9)")}, None)
_l(
    "b3_s2_cloud_shadow",
    {"cloud": (lambda: S.s2_cloud("scl", _thin(), _thick()), _s2_cloud), "shadow": (lambda: S.s2_shadow(_shade(), S.s2_cloud("scl", _thin(), _thick())), f"(qa % 60 > 30) AND NOT {_s2_cloud}")},
    None,
)
_ls_cloud = f"({_qa(*S.QA_CLOUD)} AND NOT {_qa('FILL')})"
_ls_shadow = f"({_qa(*S.QA_SHADOW)} AND NOT {_qa(*S.QA_CLOUD)} AND NOT {_qa('FILL')})"
_l("b4_landsat_cloud_shadow", {"cloud": (lambda: S.landsat_cloud("qa"), _ls_cloud), "shadow": (lambda: S.landsat_shadow("qa"), _ls_shadow)}, None)
_l("b5_no_data", {"none": (lambda: S.no_data(F.array("scl", F.col("px") % 5)), "(scl = 0 OR px % 5 = 0)"), "label": (lambda: F.when(S.no_data(F.array("scl", F.col("px") % 5)), 0).otherwise(F.col("scl")), "CASE WHEN scl = 0 OR px % 5 = 0 THEN 0 ELSE scl END")}, None)
_l("b6_blank_reference", {"reference": (lambda: F.when(F.col("scl") == 0, F.lit(0.0)).otherwise(F.col("swir16_ref")), "CASE WHEN scl = 0 THEN 0 ELSE swir16_ref END")}, 6)
_l(
    "b7_exclusion",
    {
        "s2": (lambda: S.s2_excluded("scl", S.s2_cloud("scl", _thin(), _thick()), S.s2_shadow(_shade(), S.s2_cloud("scl", _thin(), _thick()))), f"{_s2_cloud} OR (qa % 60 > 30 AND NOT {_s2_cloud}) OR scl IN (0, 1, 2, 3, 6, 7)"),
        "landsat": (lambda: S.landsat_excluded("qa"), f"{_ls_cloud} OR {_ls_shadow} OR {_qa('FILL', 'WATER')}"),
    },
    None,
)
_l("b9_any_flag", {"flagged": (lambda: F.exists(F.array(F.col("qa") % 2 == 1, F.col("scl") == 3, F.col("px") > 6), lambda x: x), "(qa % 2 = 1 OR scl = 3 OR px > 6)")}, None)
_l("b10_mask_to_null", {"swir16": (lambda: F.when(~F.col("scl").isin(*S.CLOUD_CLASSES), F.col("swir16")), "CASE WHEN scl NOT IN (8, 9) THEN swir16 END")}, None)
_l("b11_original_bands", {"swir22": (lambda: F.when(F.col("flag") == "N", F.col("swir22_ref")).otherwise(F.col("swir22")), "CASE WHEN flag = 'N' THEN swir22_ref ELSE swir22 END")}, 6)
_e("b12_masked_retrieval", {"retrieval": (lambda: F.when(F.col("prob") >= 0.6, F.col("cond")).otherwise(F.lit(0.0)), "CASE WHEN prob >= 0.6 THEN cond ELSE 0 END")})

# -- dates ---------------------------------------------------------------------------------


@query("SELECT o_orderkey AS granule_id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS also FROM orders")
def d1_two_formats(spark, sf):
    """A column of each format; either is told from all its rows."""
    given = scenes(spark, sf).select("granule_id", F.date_format("acquired", "yyyy/MM/dd").alias("slashes"), F.date_format("acquired", "yyyy-MM-dd").alias("dashes"))
    return parse_dates(parse_dates(given, "slashes", "day"), "dashes", "also").select("granule_id", "day", "also")


_o("d2_season", {"season": (lambda: S.season("acquired"), "CASE WHEN month(acquired) IN (12, 1, 2) THEN 'winter' WHEN month(acquired) IN (3, 4, 5) THEN 'spring' WHEN month(acquired) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")})
_o("d4_date_and_time", {"at": (lambda: S.at_time(F.date_format("acquired", "yyyy-MM-dd"), F.format_string("%02d:30:00", (F.col("granule_id") % 24).cast("int"))), "acquired + INTERVAL 1 HOUR * (granule_id % 24) + INTERVAL 30 MINUTE")})
_v("d5_duration_minutes", {"minutes": (lambda: S.minutes_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), "ts"), "epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / 60e6")})

# -- identifiers ---------------------------------------------------------------------------
_landsat = "concat('LC08_L1TP_', lpad(CAST(tile % 233 AS VARCHAR), 3, '0'), lpad(CAST(tile % 248 AS VARCHAR), 3, '0'), '_', strftime(acquired, '%Y%m%d'), '_', strftime(acquired + INTERVAL 10 DAY, '%Y%m%d'), '_02_', CASE WHEN granule_id % 3 = 0 THEN 'T2' ELSE 'T1' END)"


def _landsat_id() -> Column:
    three = lambda n: F.lpad((F.col("tile") % n).cast("string"), 3, "0")
    return F.concat(
        F.lit("LC08_L1TP_"), three(233), three(248), F.lit("_"), F.date_format("acquired", "yyyyMMdd"), F.lit("_"), F.date_format(F.col("acquired") + F.expr("INTERVAL 10 DAY"), "yyyyMMdd"),
        F.lit("_02_"), F.when(F.col("granule_id") % 3 == 0, "T2").otherwise("T1"),
    )


_o(
    "x1_landsat_id",
    {f: ((lambda f=f: S.parse_id(_landsat_id(), S.LANDSAT_ID, S.LANDSAT_FIELDS)[f]), f"regexp_extract({_landsat}, '{S.LANDSAT_ID}', {i + 1})") for i, f in enumerate(S.LANDSAT_FIELDS)},
)
_emit = "concat('EMIT_L2A_RFL_001_', strftime(acquired, '%Y%m%d'), 'T120000_', lpad(CAST(tile AS VARCHAR), 7, '0'), '_006')"
_emit_id = lambda: F.concat(F.lit("EMIT_L2A_RFL_001_"), F.date_format("acquired", "yyyyMMdd"), F.lit("T120000_"), F.lpad(F.col("tile").cast("string"), 7, "0"), F.lit("_006"))
_o("x2_emit_id", {f: ((lambda f=f: S.parse_id(_emit_id(), S.EMIT_ID, S.EMIT_FIELDS)[f]), f"regexp_extract({_emit}, '{S.EMIT_ID}', {i + 1})") for i, f in enumerate(S.EMIT_FIELDS)})
_o("x3_product_uri", {"uri": (lambda: S.product_uri(F.lit("data"), "sensor", F.col("tile").cast("string"), F.date_format("acquired", "yyyy-MM-dd"), suffix=".nc"), "concat_ws('/', 'data', sensor, CAST(tile AS VARCHAR), strftime(acquired, '%Y-%m-%d')) || '.nc'")})
_s2 = "concat('S2A_MSIL1C_', strftime(acquired, '%Y%m%d'), 'T101021_T', lpad(CAST(tile AS VARCHAR), 5, '0'))"
_s2_id = lambda: F.concat(F.lit("S2A_MSIL1C_"), F.date_format("acquired", "yyyyMMdd"), F.lit("T101021_T"), F.lpad(F.col("tile").cast("string"), 5, "0"))
_o("x4_s2_id", {"day": (lambda: S.id_date(_s2_id()), f"strptime(split_part({_s2}, '_', 3)[1:8], '%Y%m%d')::DATE"), "tile_name": (lambda: F.get(F.split(_s2_id(), "_"), 3), f"split_part({_s2}, '_', 4)")})
_o("x5_tile_names", {"mgrs": (lambda: S.tile_from_name(F.concat(F.lit("T"), F.col("tile").cast("string"), F.lit("_x"))), "CAST(tile AS VARCHAR)"), "padded": (lambda: S.padded_tile(F.col("tile").cast("string")), "lpad(CAST(tile AS VARCHAR), 5, '0')")})
_o("x6_sensor_letter", {"letter": (lambda: S.sensor_letter(_s2_id()), f"right(split_part({_s2}, '_', 1), 1)")})
_columns(
    "x7_catalog_name", lambda s, sf: load(s, sf, "pages").select("page_id", F.concat("url", F.lit("/catalog.json")).alias("path")), "p AS (SELECT page_id, url || '/catalog.json' AS path FROM pages)", "p", ["page_id"],
    {"name": (lambda: S.prefixed_format("path", r"\.json", ".csv"), "concat(regexp_extract(path, '([^/]+)\\.json$', 1), '.csv')")},
)
_o(
    "x8_bands_valid",
    {
        "valid": (
            lambda: S.bands_valid(F.when(F.col("sensor") == "P", F.array(F.lit("B11"), F.lit("B12"))).otherwise(F.array(F.lit("B11"), F.lit("B12"), F.lit("SCL"), F.when(F.col("sensor") == "F", "pan").otherwise("B8A"))), ("B11", "B12", "SCL"), ("pan",)),
            "(sensor = 'O')",
        )
    },
)
_columns(
    "x9_number_or_null", lambda s, sf: load(s, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "null").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("word")),
    "", "part", ["p_partkey"], {"number": (lambda: S.number_or_null("word"), "CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size AS DOUBLE) END")},
)
_c("p1_string_seed", {"seed": (lambda: S.string_seed("site"), "CAST('0x' || right(sha256(site), 8) AS BIGINT)")}, None)
_c("m19_affine", {"east": (lambda: 500000 + (F.col("x") + 0.5) * 20, "500000 + (x + 0.5) * 20"), "north": (lambda: 4000000 - (F.col("y") + 0.5) * 20, "4000000 - (y + 0.5) * 20"), "column": (lambda: F.greatest(F.lit(0), F.least(F.floor((500000 + F.col("x") * 20 - 500000) / 20), F.lit(90 - 8))).cast("double"), "CAST(greatest(0, least(floor(x * 20 / 20), 82)) AS DOUBLE)")})
_c("m21_box", {k: ((lambda s=s, a=a: F.col(a) + s * 5 * S.DEGREES_PER_KM), f"{a} {'+' if s > 0 else '-'} 5 * (1 / 111.0)") for k, a, s in (("west", "x", -1), ("east", "x", 1), ("south", "y", -1), ("north", "y", 1))})
_c("f14_clip_box", {"lon": (lambda: F.greatest(F.lit(-180.0), F.least(F.col("x") * 3, F.lit(180.0))), "greatest(-180, least(x * 3, 180))"), "lat": (lambda: F.greatest(F.lit(-90.0), F.least(F.col("y"), F.lit(90.0))), "greatest(-90, least(y, 90))")})
_c("p13_pareto_emission", {"emission": (lambda: F.least(100 / (1 - S.uniform("site")), F.lit(100000.0)), "least(100 / (1 - CAST('0x' || right(sha256(site), 8) AS BIGINT) / 4294967296.0), 100000)")})

# -- rasters -------------------------------------------------------------------------------
_64 = SIDE * SIDE


def _chip(name: str, make: Callable[[], Column], sql: str, alias: str = "raster") -> None:
    _columns(name, chips, CHIPS, "chips", ["chip_id"], {alias: (make, sql)})


def _rounded(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: F.format_number(v, 4)), " ")


def _rounded_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: printf('%.4f', v)), ' ')"


_names = lambda: F.array(*[F.lit(f"B{i}") for i in range(4)])
# integers, so that text forms agree
_int = lambda: F.transform("raster", lambda v: F.rint(v * 1000).cast("long"))
_INT = "list_transform(raster, lambda v: CAST(round_even(v * 1000, 0) AS BIGINT))"
_text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
_TEXT = lambda x: f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ' ')"
_chip("r1_select_bands", lambda: _text(R.select_bands(_int(), _names(), ["B2", "B0"], 16)), _TEXT(f"list_concat({_INT}[33:48], {_INT}[1:16])"))
_chip("r2_concat_snapshots", lambda: _text(R.concat_snapshots(F.slice(_int(), 17, 16), F.slice(_int(), 1, 16), F.slice(_int(), 33, 16))), _TEXT(f"list_concat({_INT}[17:32], list_concat({_INT}[1:16], {_INT}[33:48]))"))
_chip(
    "r3_flip_rotate",
    lambda: F.when(S.string_seed(F.col("chip_id").cast("string")) % 2 == 0, _text(R.flip_horizontal(_int(), SIDE))).otherwise(_text(R.rotate90(_int(), SIDE))),
    f"CASE WHEN CAST('0x' || right(sha256(CAST(chip_id AS VARCHAR)), 8) AS BIGINT) % 2 = 0 THEN {_TEXT(f'list_transform(range(64), lambda i: {_INT}[i - i % 8 + 7 - i % 8 + 1])')} ELSE {_TEXT(f'list_transform(range(64), lambda i: {_INT}[(i % 8) * 8 + (7 - i // 8) + 1])')} END",
)
_chip("r4_crop", lambda: _text(R.crop(_int(), SIDE, 2, 3, 3, 4)), _TEXT(f"list_concat({_INT}[20:23], list_concat({_INT}[28:31], {_INT}[36:39]))"))
_chip("r5_pad", lambda: _text(R.pad(F.slice(_int(), 1, 4), 2, 2, 3, fill=0).cast("array<bigint>")), _TEXT(f"[{_INT}[1], {_INT}[2], 0, {_INT}[3], {_INT}[4], 0, 0, 0, 0]"))
_chip("r7_clean_plume", lambda: _text(F.transform(R.clean_plume("raster", 1000.0), lambda v: F.rint(v).cast("long"))), _TEXT("list_transform(raster, lambda v: CAST(round_even(greatest(v, 0) * 1000, 0) AS BIGINT))"))
_chip("r10_rgb", lambda: _text(F.transform(R.scaled(R.select_bands("raster", _names(), ["B3", "B2", "B1"], 16), 2000.0), lambda v: F.rint(v).cast("long"))), _TEXT("list_transform(list_concat(raster[49:64], list_concat(raster[33:48], raster[17:32])), lambda v: CAST(round_even(v * 2000, 0) AS BIGINT))"))
_l("r11_first_or_zero", {"rate": (lambda: R.first_or_zero(F.when(F.col("px") % 2 == 0, F.array("swir16")).otherwise(F.array().cast("array<double>"))), "CASE WHEN px % 2 = 0 THEN swir16 ELSE 0 END")}, 6)
_chip("f19_has_signal", lambda: R.has_signal(F.transform("raster", lambda v: F.when(F.col("chip_id") % 5 == 0, 0.0).otherwise(v))), "(chip_id % 5 <> 0)", "signal")
