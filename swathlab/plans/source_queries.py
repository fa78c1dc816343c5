"""Readers and writers: each query writes what it reads from the given tables to a shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io as IO
from .bindings import CHIPS, chips, load, query


@query("SELECT vec_id, label FROM embeddings")
def s1_scan_chips(spark, sf):
    return IO.scan_chips(spark, f"{sf}/embeddings.parquet", ["vec_id", "label"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def s2_projected_read(spark, sf):
    return IO.scan_chips(spark, f"{sf}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_extendedprice")


def _table_of(path):
    """The table that a file belongs to."""
    return F.regexp_extract(path, r"([a-z]+)\.parquet", 1).alias("source")


@query("SELECT o_orderkey, 'orders' AS source, TRUE AS placed FROM orders")
def s3_lineage(spark, sf):
    rows = IO.with_lineage(spark, f"{sf}/orders.parquet")
    return rows.select("o_orderkey", _table_of("path"), (F.col("block_start") >= 0).alias("placed"))


@query("SELECT 'lineitem' AS source, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def s4_rows_per_file(spark, sf):
    rows = IO.rows_per_file(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "part")])
    return rows.groupBy(_table_of("path")).agg(F.sum("n").alias("n"))


_CUSTOMER = "c_custkey long, c_name string, c_acctbal double"


def _csv(spark, sf, name):
    out = IO.scratch(spark, name)
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(out, header=True)
    return out


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def s5_read_csvs(spark, sf):
    return IO.read_csvs(spark, [_csv(spark, sf, "s5a"), _csv(spark, sf, "s5b")], _CUSTOMER).drop("file")


@query("SELECT o_orderkey AS id, concat(CAST(o_custkey AS VARCHAR), '-', CAST(o_orderkey AS VARCHAR)) AS key, CAST(o_orderdate AS DATE) AS day FROM orders")
def s6_csv_to_parquet(spark, sf):
    raw, out = IO.scratch(spark, "s6"), IO.scratch(spark, "s6")
    load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tile"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("date")).write.csv(raw, header=True)
    IO.csv_to_parquet(spark, raw, out, "id long, tile long, date string", ["id", "tile", "date"], {"key": F.concat_ws("-", F.col("tile").cast("string"), F.col("id").cast("string"))}, {"day": "date"})
    return spark.read.parquet(out).select("id", "key", "day")


@query("SELECT event_type AS kind, event_id, value FROM events")
def s7_read_catalog(spark, sf):
    out = IO.scratch(spark, "s7")
    listed = load(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 64).alias("part")).agg(F.collect_list(F.struct("event_id", "value")).alias("plumes"))
    listed.select("event_type", "plumes").write.json(out)
    found = IO.read_catalog(spark, out, "event_type string, plumes array<struct<event_id: long, value: double>>", "plumes", keep=("event_type",), lines=True)
    return found.select(F.col("event_type").alias("kind"), "item.event_id", "item.value")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS region, CAST(i AS INTEGER) AS i, CAST(n_nationkey + i % 2 AS DOUBLE) AS x, CAST(n_nationkey + i // 2 AS DOUBLE) AS y FROM nation, (SELECT unnest(range(4)) AS i)")
def s8_read_geojson(spark, sf):
    out, k = IO.scratch(spark, "s8"), F.col("n_nationkey")
    corner = lambda i: F.array((k + i % 2).cast("double"), (k + i // 2).cast("double"))
    ring = F.array(F.array(*[corner(i) for i in (0, 1, 2, 3, 0)]))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("name"), k.cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    # one document of 25 features, as such files come
    load(spark, sf, "nation").groupBy(F.lit("FeatureCollection").alias("type")).agg(F.collect_list(feature).alias("features")).write.json(out)
    return IO.read_regions(spark, out, "name")


@query("SELECT vec_id AS chip_id, label % 3 AS region, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def s9_write_chips(spark, sf):
    out = IO.scratch(spark, "s9")
    IO.write_chips(chips(spark, sf), out)
    return spark.read.parquet(out).select("chip_id", "region", F.size("raster").alias("n"))


@query("SELECT count(*) AS n, TRUE AS refused FROM nation")
def s10_fail_if_exists(spark, sf):
    from pyspark.errors import AnalysisException

    out, rows, refused = IO.scratch(spark, "s10"), load(spark, sf, "nation"), False
    IO.write_chips(rows, out)
    try:
        IO.write_chips(rows, out)
    except AnalysisException:
        refused = True
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def s11_json_summary(spark, sf):
    out = IO.scratch(spark, "s11")
    load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).write.json(out)
    return spark.read.json(out, schema="flag string, n long")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s12_write_csv(spark, sf):
    return spark.read.csv(_csv(spark, sf, "s12"), schema=_CUSTOMER, header=True)


@query("SELECT c_custkey AS site_id, c_acctbal AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer")
def s13_geojson_features(spark, sf):
    out = IO.scratch(spark, "s13")
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    IO.geojson_features(rows, "x", "y", ["site_id"]).write.text(out)
    back = spark.read.text(out).select(F.from_json("value", "geometry struct<coordinates: array<double>>, properties struct<site_id: long>").alias("f"))
    return back.select("f.properties.site_id", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


@query("SELECT o_orderstatus AS worker, count(*) AS n FROM orders GROUP BY 1")
def s14_merge_worker_files(spark, sf):
    out = IO.scratch(spark, "s14")
    load(spark, sf, "orders").withColumn("worker", F.col("o_orderstatus")).write.partitionBy("worker").parquet(out)
    return spark.read.parquet(out).groupBy("worker").agg(F.count("*").alias("n"))


@query(f"WITH {CHIPS} SELECT chip_id, array_to_string(list_transform(raster, lambda v: CAST(CAST(round_even(v * 1000, 0) AS BIGINT) AS VARCHAR)), ' ') AS pixels, 64 AS n FROM chips")
def s15_decode_rasters(spark, sf):
    encoded = IO.encode_rasters(chips(spark, sf), "raster", "<f8")
    decoded = IO.decode_rasters(encoded, "raster", "<f8", (1, 8, 8))
    return decoded.select("chip_id", F.array_join(F.transform("raster", lambda v: F.rint(v * 1000).cast("long").cast("string")), " ").alias("pixels"), F.size("raster").alias("n"))


@query(f"WITH {CHIPS}, i AS (SELECT chip_id, list_transform(raster, lambda v: (CAST(round_even(v * 10000, 0) AS INTEGER) + 65536) % 65536) AS v FROM chips) SELECT chip_id, array_to_string(list_transform(v, lambda x: lpad(to_hex(x % 256), 2, '0') || lpad(to_hex(x // 256), 2, '0')), '') AS bytes FROM i")
def s16_encode_rasters(spark, sf):
    scaled = chips(spark, sf).select("chip_id", F.transform("raster", lambda v: F.rint(v * 10000).cast("smallint")).alias("raster"))
    return IO.encode_rasters(scaled, "raster", "<i2").select("chip_id", F.hex("raster").alias("bytes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def s17_flatten(spark, sf):
    rows = load(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return IO.flattened(rows, "props")


@query("SELECT 64 AS size, 'B11 B12' AS bands, TRUE AS all_agree FROM embeddings LIMIT 1")
def s18_shape_of_first(spark, sf):
    rows = chips(spark, sf).select(F.size("raster").alias("size"), F.array(F.lit("B11"), F.lit("B12")).alias("bands"))
    return IO.shape_of_first(rows, "size", "bands").withColumn("bands", F.array_join("bands", " "))
