"""Rasters as rows of pixels: trimming, block means, rows back to arrays, buffers around the centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trim_border(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The pixels of the smallest box that holds all values other than 0, rows and columns counted from its corner; a raster of zeros has none."""
    whole, some = Window.partitionBy(*keys), F.col(value) != 0
    edge = {f"_{name}": f(F.when(some, F.col(c))).over(whole) for name, f, c in (("r0", F.min, "row"), ("r1", F.max, "row"), ("c0", F.min, "col"), ("c1", F.max, "col"))}
    boxed = pixels.withColumns(edge).where("row BETWEEN _r0 AND _r1 AND col BETWEEN _c0 AND _c1")
    return boxed.withColumns({"row": F.col("row") - F.col("_r0"), "col": F.col("col") - F.col("_c0")}).drop(*edge)


def block_mean(pixels: DataFrame, keys: list[str], value: str, block: int) -> DataFrame:
    """keys, row, col of blocks, and the mean of each block's values."""
    return pixels.groupBy(*keys, F.floor(F.col("row") / block).alias("row"), F.floor(F.col("col") / block).alias("col")).agg(F.avg(value).alias(value))


def to_arrays(pixels: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """keys and the values of each raster as an array, row by row."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("row") * width + F.col("col")).alias("pos"), F.col(value).alias("v"))))
    return pixels.groupBy(*keys).agg(F.transform(cells, lambda x: x["v"]).alias(value))


def within_centre(size: int, reach: int) -> Column:
    """Whether a pixel is at most ``reach`` from the middle of the raster in rows and columns (2 * reach pixels a side)."""
    low, high = size // 2 - reach, size // 2 + reach - 1
    return F.col("row").between(low, high) & F.col("col").between(low, high)


def centre_buffer(pixels: DataFrame, keys: list[str], probability: str, retrieval: str, size: int, reach: int) -> DataFrame:
    """highest and mean probability, and total absolute marginal retrieval, around the centre."""
    near = pixels.where(within_centre(size, reach))
    return near.groupBy(*keys).agg(F.max(probability).alias("highest"), F.avg(probability).alias("mean"), F.sum(F.abs(F.col(probability) * F.col(retrieval))).alias("total"))


def reference_stack(pixels: DataFrame, keys: list[str], rank: str, value: str, most: int, middle: int) -> DataFrame:
    """The mean over the first ``most`` references and the median over the first ``middle`` ones, at each pixel of a stack."""
    stack = pixels.where(F.col(rank) <= most)
    return stack.groupBy(*keys, "row", "col").agg(F.avg(value).alias("mean"), F.median(F.when(F.col(rank) <= middle, F.col(value))).alias("middle"))


def slope_through_point(rows: DataFrame, keys: list[str], x: str, y: str, x0: float) -> DataFrame:
    """The slope of the least-squares line through (x0, 0) of each group; null if no x differs from x0."""
    d = F.col(x) - x0
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(d * F.col(y)), F.sum(d * d)).alias("slope"))
