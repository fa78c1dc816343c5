"""Planar geometry as joins and expressions: points in polygons, rectangle overlap, nearest areas.

Polygons are rings of (x, y) in order, not closed, as rows of edges: region, i, x0, y0, x1, y1. Candidates meet
in square cells (of a side given by the caller), so that only neighbours are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(vertices: DataFrame, region: str, order: str, x: str, y: str) -> DataFrame:
    """Edges of rings given by their vertices in order; the last is joined to the first."""
    ring = Window.partitionBy(region).orderBy(order)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead(F.struct(x, y)).over(ring), F.first(F.struct(x, y)).over(whole))
    return vertices.select(F.col(region), F.col(order).alias("i"), F.col(x).alias("x0"), F.col(y).alias("y0"), nxt[x].alias("x1"), nxt[y].alias("y1"))


def boxes(edge_rows: DataFrame, region: str) -> DataFrame:
    return edge_rows.groupBy(region).agg(F.min("x0").alias("xmin"), F.max("x0").alias("xmax"), F.min("y0").alias("ymin"), F.max("y0").alias("ymax"))


def _cells(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))


def in_regions(points: DataFrame, key: str, x: str, y: str, edge_rows: DataFrame, region: str, side: float) -> DataFrame:
    """(key, region) of points inside a region, by even-odd crossings of a ray to the right.

    An edge and a point meet in horizontal bands of height ``side``; both sides of the join are by band, and
    a crossing count per (point, region) decides. A point on a boundary may fall on either side.
    """
    band = edge_rows.select(region, "x0", "y0", "x1", "y1", _cells(F.least("y0", "y1"), F.greatest("y0", "y1"), side).alias("_band"))
    placed = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(y) / side).alias("_band"))
    spans = (F.col("y0") > F.col("_y")) != (F.col("y1") > F.col("_y"))
    right = F.col("_x") < (F.col("x1") - F.col("x0")) * (F.col("_y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    crossings = placed.join(band, "_band").where(spans).where(right).groupBy(key, region).agg(F.count("*").alias("_n"))
    return crossings.where("_n % 2 = 1").select(key, region)


def _cut(points: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """A ring cut by one half-plane: inner vertices stay, crossings are added."""
    other, n = ("y" if axis == "x" else "x"), F.size(points)
    none = F.array().cast("array<struct<x:double,y:double>>")

    def inside(v: Column) -> Column:
        return v[axis] >= bound if keep_above else v[axis] <= bound

    def part(p: Column, i: Column) -> Column:
        q = F.element_at(points, (i + 1) % n + 1)
        at = p[other] + (bound - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        crossing = F.struct((bound if axis == "x" else at).alias("x"), (at if axis == "x" else bound).alias("y"))
        own = F.when(inside(p), F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(none)
        return F.concat(own, F.when(inside(p) != inside(q), F.array(crossing)).otherwise(none))

    return F.flatten(F.transform(points, part))


def with_clip_area(rows: DataFrame, x0: str, y0: str, x1: str, y1: str, xs: str, ys: str, out: str) -> DataFrame:
    """``rows`` with the area of the overlap of the rectangle [x0, x1] x [y0, y1] and a polygon (arrays of vertices).

    The polygon is cut by the rectangle's four half-planes in turn, then the shoelace formula is
    applied: exact, as the rectangle is convex. Each cut is a column of its own, so that it is computed once.
    """
    rows = rows.withColumn("_p", F.arrays_zip(F.col(xs).alias("x"), F.col(ys).alias("y")).cast("array<struct<x:double,y:double>>"))
    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        rows = rows.withColumn("_p", _cut(F.col("_p"), axis, F.col(bound).cast("double"), above))
    n = F.size("_p")
    terms = F.transform("_p", lambda p, i: p["x"] * F.element_at(F.col("_p"), (i + 1) % n + 1)["y"] - F.element_at(F.col("_p"), (i + 1) % n + 1)["x"] * p["y"])
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2
    # exploded, so that a filter on the area isn't pushed into the cuts and computed anew in each
    return rows.select(*[c for c in rows.columns if c != "_p"], F.explode(F.array(area)).alias(out))


def box_matches(left: DataFrame, left_key: str, right: DataFrame, right_key: str, side: float) -> DataFrame:
    """Distinct (left_key, right_key) of boxes (xmin, xmax, ymin, ymax) that touch; each pair is made in the one cell where it starts."""
    def dealt(rows: DataFrame, key: str, prefix: str) -> DataFrame:
        named = rows.select(F.col(key), *[F.col(c).alias(f"{prefix}{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
        return named.withColumn("_cx", _cells(F.col(f"{prefix}xmin"), F.col(f"{prefix}xmax"), side)).withColumn("_cy", _cells(F.col(f"{prefix}ymin"), F.col(f"{prefix}ymax"), side))

    met = dealt(left, left_key, "_a").join(dealt(right, right_key, "_b"), ["_cx", "_cy"])
    touch = (F.col("_axmin") <= F.col("_bxmax")) & (F.col("_bxmin") <= F.col("_axmax")) & (F.col("_aymin") <= F.col("_bymax")) & (F.col("_bymin") <= F.col("_aymax"))
    home = (F.floor(F.greatest("_axmin", "_bxmin") / side) == F.col("_cx")) & (F.floor(F.greatest("_aymin", "_bymin") / side) == F.col("_cy"))
    return met.where(touch & home).select(left_key, right_key)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment."""
    length2 = F.pow(x1 - x0, 2) + F.pow(y1 - y0, 2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0), length2), F.lit(0.0))))
    return F.hypot(px - (x0 + t * (x1 - x0)), py - (y0 + t * (y1 - y0)))


def equal_area_share(lon0: Column, lat0: Column, lon1: Column, lat1: Column, of_lon0: Column, of_lat0: Column, of_lon1: Column, of_lat1: Column) -> Column:
    """Share of the second lon/lat box that the first covers, on the sphere (area goes with lon and sin lat)."""
    width = F.greatest(F.lit(0.0), F.least(lon1, of_lon1) - F.greatest(lon0, of_lon0))
    height = F.greatest(F.lit(0.0), F.sin(F.radians(F.least(lat1, of_lat1))) - F.sin(F.radians(F.greatest(lat0, of_lat0))))
    return F.try_divide(width * height, (of_lon1 - of_lon0) * (F.sin(F.radians(of_lat1)) - F.sin(F.radians(of_lat0))))
