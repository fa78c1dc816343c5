"""Joins: rates onto lists, time and place lookups, nearest keys, grids of jobs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def rates_for_lists(rows: DataFrame, keys: list[str], items: str, rates: DataFrame, item: str, rate: str) -> DataFrame:
    """The rates of a list's items in their order; an item without one takes the median of all rates, rounded to one digit."""
    middle = exact_quantiles(rates, [], F.col(rate), [0.5]).select(F.round(F.col("quantiles")[0], 1).alias("_median"))  # one row
    listed = rows.select(*keys, F.posexplode(items).alias("_pos", item))
    joined = listed.join(rates.select(item, rate), item, "left").crossJoin(F.broadcast(middle))
    ordered = F.sort_array(F.collect_list(F.struct("_pos", F.coalesce(rate, "_median").alias("rate"))))
    return joined.groupBy(*keys).agg(F.transform(ordered, lambda x: x["rate"]).alias("rates"))


def one_per_minute(rows: DataFrame, time: str, wind: DataFrame, wind_time: str, values: list[str]) -> DataFrame:
    """Rows with the wind of their minute, and how many readings there were; values only where there is exactly one."""
    minute = wind.groupBy(F.date_trunc("minute", wind_time).alias("_minute")).agg(F.count("*").alias("matches"), *[F.min(v).alias(v) for v in values])
    out = rows.withColumn("_minute", F.date_trunc("minute", time)).join(minute, "_minute", "left")
    n = F.coalesce("matches", F.lit(0))
    return out.withColumns({v: F.when(n == 1, F.col(v)) for v in values}).withColumn("matches", n).drop("_minute")


def nearest_grid_cell(points: DataFrame, grid: DataFrame, x: str, y: str, x0: float, y0: float, step: float) -> DataFrame:
    """Points with the values of the nearest cell of a regular grid (columns ix, iy): an equi-join on the cell."""
    cell = points.withColumn("ix", F.rint((F.col(x) - x0) / step).cast("long")).withColumn("iy", F.rint((F.col(y) - y0) / step).cast("long"))
    return cell.join(grid, ["ix", "iy"], "left")


def pairs_within(rows: DataFrame, keys: list[str], item: str, ordered: bool) -> DataFrame:
    """All ordered pairs of a key's items, or the unordered ones with repetition. Meant for keys of a few items: the pairs are the result."""
    a = rows.select(*keys, F.col(item).alias("first"))
    b = rows.select(*keys, F.col(item).alias("second"))
    both = a.join(b, keys)
    return both if ordered else both.where("first <= second")


def named_references(mains: DataFrame, refs: DataFrame, keys: list[str], before: str, earlier: str, date: str, item: str) -> DataFrame:
    """Mains with the items of two named dates; ``missing`` tells where a date has none."""
    out = mains
    for name in (before, earlier):
        out = out.join(refs.select(*keys, F.col(date).alias(name), F.col(item).alias(f"{name}_item")), [*keys, name], "left")
    return out.withColumn("missing", F.col(f"{before}_item").isNull() | F.col(f"{earlier}_item").isNull())


def aligned_product(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The product of two curves on the same grid; an error when the grids differ."""
    both = left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select(key, F.when(same, F.col("_a") * F.col("_b")).otherwise(F.raise_error(F.lit("the grids differ")).cast("double")).alias(value))


def aligned_curves(curves: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """keys and a column for each named curve, all on one grid; an error where a curve lacks a place, holds it twice or has no value there.

    The curves are united and grouped, so any number of them costs one exchange.
    """
    names = list(curves)
    rows = [c.select(*keys, F.lit(i).alias("_i"), F.col(value).cast("double").alias("_v")) for i, c in enumerate(curves.values())]
    both = functools.reduce(DataFrame.unionByName, rows)
    each = {f"_{i}": F.max(F.when(F.col("_i") == i, F.col("_v"))) for i in range(len(names))}
    found = both.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count("_v").alias("_n"), *[v.alias(k) for k, v in each.items()])
    whole = functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in each]) & (F.col("_rows") == len(names)) & (F.col("_n") == len(names))
    return found.select(*keys, *[F.when(whole, F.col(f"_{i}")).otherwise(F.raise_error(F.lit("the grids differ")).cast("double")).alias(n) for i, n in enumerate(names)])


def thresholds(spark, values: list[tuple], names: list[str]) -> DataFrame:
    """A small table of parameters, to be crossed with rows before an aggregate."""
    return spark.createDataFrame(values, names)


def with_each(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Every row with every row of a small table of parameters (given in code, so its size doesn't follow the data)."""
    return rows.crossJoin(F.broadcast(small))


def nearest(points: Column, knots: list[float]) -> Column:
    """The knot next to a value, the lower one on ties; knots are given in code."""
    return F.element_at(F.sort_array(F.array(*[F.struct(F.abs(points - k).alias("d"), F.lit(k).alias("k")) for k in knots])), 1)["k"]
