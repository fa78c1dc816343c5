"""The given tables under the names that the operators use, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def register(name: str, function: Query, sql: str | None = None) -> None:
    QUERIES[name] = function
    if sql:
        ORACLE_SQL[name] = sql


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- E: embeddings as chips of 8 x 8 pixels ---------------------------------------------
SIDE = 8


def chips(spark: SparkSession, sf: str) -> DataFrame:
    """chip_id, region, raster (64 floats)."""
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("chip_id"), (F.col("label") % 3).alias("region"), F.col("embedding").cast("array<double>").alias("raster"))


CHIPS = "chips AS (SELECT vec_id AS chip_id, label % 3 AS region, CAST(embedding AS DOUBLE[]) AS raster FROM embeddings)"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """chip_id, region, row, col, v, prob, cond, target: one row per pixel."""
    exploded = chips(spark, sf).select("chip_id", "region", "raster", F.posexplode("raster").alias("pos", "v"))
    return exploded.select(
        "chip_id", "region", F.floor(F.col("pos") / SIDE).cast("int").alias("row"), (F.col("pos") % SIDE).alias("col"), "v",
        (1 / (1 + F.exp(-10 * F.col("v")))).alias("prob"), F.element_at("raster", (F.col("pos") * 7 + 3) % 64 + 1).alias("cond"), F.element_at("raster", (F.col("pos") * 5 + 1) % 64 + 1).alias("target"),
    )


PIXELS = (
    CHIPS + ", pos AS (SELECT unnest(range(64)) AS pos), pixels AS (SELECT chip_id, region, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 AS INTEGER) AS col, raster[pos + 1] AS v, "
    "1 / (1 + exp(-10 * raster[pos + 1])) AS prob, raster[(pos * 7 + 3) % 64 + 1] AS cond, raster[(pos * 5 + 1) % 64 + 1] AS target FROM chips, pos)"
)


def chip_values(spark: SparkSession, sf: str) -> DataFrame:
    """chip_id, region, prob, cond, target: one row per chip, arrays of 64 values each (those of ``pixels``)."""
    moved = lambda step, start: F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.element_at("raster", (i * step + start) % 64 + 1))
    return chips(spark, sf).select("chip_id", "region", F.transform("raster", lambda v: 1 / (1 + F.exp(-10 * v))).alias("prob"), moved(7, 3).alias("cond"), moved(5, 1).alias("target"))


def lab_sql(name: str, marker: float, floor: float) -> str:
    """SQL of labelled components: pixels of components with a label, as the table ``name``; for WITH RECURSIVE."""
    return f"""{name}_m AS (SELECT chip_id, row * 8 + col AS id FROM pixels WHERE prob >= {floor}),
{name}_r AS (SELECT chip_id, id, id AS root FROM {name}_m UNION SELECT r.chip_id, m.id, r.root FROM {name}_r r JOIN {name}_m m ON m.chip_id = r.chip_id AND abs(m.id // 8 - r.id // 8) <= 1 AND abs(m.id % 8 - r.id % 8) <= 1),
{name}_l AS (SELECT chip_id, id, min(root) + 1 AS label FROM {name}_r GROUP BY ALL),
{name} AS (SELECT p.*, CAST(label AS INTEGER) AS label FROM {name}_l l JOIN pixels p ON p.chip_id = l.chip_id AND p.row * 8 + p.col = l.id WHERE (l.chip_id, label) IN (SELECT l.chip_id, label FROM {name}_l l JOIN pixels p ON p.chip_id = l.chip_id AND p.row * 8 + p.col = l.id WHERE prob >= {marker}))"""


# -- L: lineitem as pixels with two bands, class and QA bits ---------------------------
def band_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """chip_id, px, granule, swir16, swir22, swir16_ref, swir22_ref, scl, qa, acquired, flag."""
    p = F.col("l_extendedprice")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chip_id"), F.col("l_linenumber").alias("px"), (F.col("l_suppkey") % 50).alias("granule"), p.alias("swir16"), (p * (1 - F.col("l_discount"))).alias("swir22"),
        (p * (1 + F.col("l_tax"))).alias("swir16_ref"), p.alias("swir22_ref"), (F.col("l_quantity").cast("int") % 12).alias("scl"), (F.col("l_partkey") % 65536).cast("int").alias("qa"),
        F.col("l_shipdate").alias("acquired"), F.col("l_returnflag").alias("flag"),
    )


BAND_PIXELS = (
    "px AS (SELECT l_orderkey AS chip_id, l_linenumber AS px, l_suppkey % 50 AS granule, l_extendedprice AS swir16, l_extendedprice * (1 - l_discount) AS swir22, "
    "l_extendedprice * (1 + l_tax) AS swir16_ref, l_extendedprice AS swir22_ref, CAST(l_quantity AS INTEGER) % 12 AS scl, CAST(l_partkey % 65536 AS INTEGER) AS qa, l_shipdate AS acquired, l_returnflag AS flag FROM lineitem)"
)


# -- O: orders as scenes -----------------------------------------------------------------
def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """granule_id, tile, acquired, sensor, category, cloud_pct, nodata_pct."""
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("granule_id"), F.col("o_custkey").alias("tile"), F.col("o_orderdate").alias("acquired"), F.col("o_orderstatus").alias("sensor"),
        F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") / 5000).alias("cloud_pct"), (F.col("o_orderkey") % 100 / 10).alias("nodata_pct"),
    )


SCENES = (
    "scenes AS (SELECT o_orderkey AS granule_id, o_custkey AS tile, o_orderdate AS acquired, o_orderstatus AS sensor, o_orderpriority AS category, "
    "o_totalprice / 5000 AS cloud_pct, (o_orderkey % 100) / 10 AS nodata_pct FROM orders)"
)


# -- V: events as wind series ------------------------------------------------------------
def wind(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, station, ts, u, v, kind, props."""
    return load(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("station"), "ts", (F.col("value") / 100 - 2.5).alias("u"), (F.col("value") % 7 - 3).alias("v"), F.col("event_type").alias("kind"), "props"
    )


WIND = "wind AS (SELECT event_id, user_id AS station, ts, value / 100 - 2.5 AS u, value % 7 - 3 AS v, event_type AS kind, props FROM events)"


# -- P: part as a spectral curve; C: customers as sites ----------------------------------
def curve(spark: SparkSession, sf: str) -> DataFrame:
    """wavelength, response (mean of its parts), sorted by nothing."""
    return load(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("wavelength")).agg(F.round(F.avg("p_retailprice"), 6).alias("response"))


CURVE = "curve AS (SELECT CAST(p_size AS DOUBLE) AS wavelength, round(avg(p_retailprice), 6) AS response FROM part GROUP BY 1)"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """site_id, site, region, x, y, q."""
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("site_id"), F.col("c_name").alias("site"), (F.col("c_nationkey") % 5).alias("region"),
        (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), F.col("c_acctbal").alias("q"),
    )


SITES = "sites AS (SELECT c_custkey AS site_id, c_name AS site, c_nationkey % 5 AS region, c_acctbal / 100 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y, c_acctbal AS q FROM customer)"
