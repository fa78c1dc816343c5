"""Readers and writers: parquet chips, CSV lists, JSON catalogs, GeoJSON, raster bytes."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DATE_FORMATS, date_by


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, in local mode else in the warehouse."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a new shared folder and read again: computed once, its lineage cut."""
    out = scratch(rows.sparkSession, name)
    rows.write.parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def observed(rows: DataFrame, name: str, *values: Column) -> tuple[DataFrame, dict]:
    """``written`` rows and aggregates of them (by their names) that the write itself counts: no second pass."""
    seen = Observation()
    return written(rows.observe(seen, *values), name), seen.get


def scan_chips(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All parquet files below a folder, only the columns asked for."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.select(*columns) if columns else rows


def with_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``path`` and ``file`` (its name), and ``block_start``, the start of the part of the file they were read from."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))


def rows_per_file(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, file and n, the rows of each file under the paths. Files without rows are left out."""
    return functools.reduce(DataFrame.union, [with_lineage(spark, p).groupBy("path", "file").agg(F.count("*").alias("n")) for p in paths])


def read_csvs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV files or folders as one table with ``file``."""
    return spark.read.csv(paths, schema=schema, header=True).select("*", F.col("_metadata.file_name").alias("file"))


def parse_dates(rows: DataFrame, column: str, out: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """``rows`` with the text of a column as a date, by the first format that fits all rows; nulls stay null.

    One aggregate counts the rows that each format doesn't fit. An error if no format fits all rows.
    """
    fails = [F.count_if(F.col(column).isNotNull() & date_by(column, form).isNull()) for form in formats]
    form = next((form for form, n in zip(formats, rows.agg(*[n.alias(f"_{i}") for i, n in enumerate(fails)]).first(), strict=True) if not n), None)
    if form is None:
        raise ValueError(f"{column}: no format of {', '.join(formats)} fits all rows")
    return rows.withColumn(out, date_by(column, form))


def csv_to_parquet(spark: SparkSession, path: str, out: str, schema: str, required: list[str], derived: dict, dates: dict[str, str] | None = None) -> None:
    """CSV to parquet with derived columns, and dates (new name: column of text); an error for missing columns or dates in
    several formats, before anything is written."""
    rows = spark.read.csv(path, schema=schema, header=True)
    given = spark.read.csv(path, header=True).columns
    if missing := [c for c in required if c not in given]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name, column in (dates or {}).items():
        rows = parse_dates(rows, column, name)
    rows.withColumns(derived).write.parquet(out)


def read_catalog(spark: SparkSession, path: str, schema: str, items: str, keep: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """JSON catalogs with a list of items: a row per item, with the catalog's ``keep`` fields. ``lines``: a catalog a line, else a file each."""
    return spark.read.json(path, schema=schema, multiLine=not lines).select(*keep, F.explode(items).alias("item"))


GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def read_regions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Vertices of a GeoJSON file's outer rings: region, i, x, y (the closing vertex left out)."""
    features = spark.read.json(path, schema=GEOJSON, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    rows = features.select(F.col("f.properties")[name].alias("region"), F.posexplode(F.slice(ring, F.lit(1), F.size(ring) - 1)).alias("i", "p"))
    return rows.select("region", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def write_chips(rows: DataFrame, path: str) -> None:
    """zstd parquet with statistics and usual row groups; an error if the folder exists."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def geojson_features(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One column ``value``: each row as a GeoJSON point feature."""
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def flattened(rows: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns named column_field."""
    fields = rows.schema[column].dataType.names
    return rows.select(*[c for c in rows.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


def shape_of_first(rows: DataFrame, size: str, bands: str) -> DataFrame:
    """One row: the first row's size and bands, and whether all rows agree with it."""
    first = rows.select(F.col(size).alias("size"), F.col(bands).alias("bands")).limit(1)
    kinds = rows.agg((F.min(size) == F.max(size)).alias("_s"), (F.min(bands) == F.max(bands)).alias("_b"))
    return first.crossJoin(F.broadcast(kinds)).select("size", "bands", (F.col("_s") & F.col("_b")).alias("all_agree"))


#: NumPy's name of a type: Spark's element type.
KINDS = {"<i2": "smallint", "<f4": "float", "<f8": "double", "|b1": "boolean"}


def decode_rasters(rows: DataFrame, column: str, dtype: str, shape: tuple[int, ...]) -> DataFrame:
    """Raster bytes (C order, little-endian) as a flat array; an error where the length isn't the shape's. Null stays null."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    checked = rows.withColumn(column, F.when(F.col(column).isNull() | (F.octet_length(column) == size), F.col(column)).otherwise(F.raise_error(F.lit(f"{column}: not {size} bytes")).cast("binary")))
    return _mapped(checked, column, f"array<{KINDS[dtype]}>", lambda a: _lists(a, dtype))


def encode_rasters(rows: DataFrame, column: str, dtype: str) -> DataFrame:
    """Flat arrays as raster bytes."""
    return _mapped(rows, column, "binary", lambda a: pa.array([None if v is None else np.asarray(v, dtype).tobytes() for v in a.to_pylist()], pa.binary()))


def _lists(values: pa.Array, dtype: str) -> pa.Array:
    return pa.array([None if v is None else np.frombuffer(v, dtype) for v in values.to_pylist()], pa.list_(pa.from_numpy_dtype(np.dtype(dtype))))


def _mapped(rows: DataFrame, column: str, kind: str, change) -> DataFrame:
    at, names = rows.columns.index(column), rows.columns
    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([change(c) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return rows.mapInArrow(run, schema)
