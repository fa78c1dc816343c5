"""Nearest neighbours at any density: a tree of counted cells over the targets, descended by all queries at once.

A cell has 4 x 4 cells of the next level. Levels are counted one by one; a cell of up to ``LEAF`` targets is a leaf and keeps
its targets, others are divided. Each cell knows the box around its targets, so that a query's cells bound the
distance from both sides: a cell whose nearest corner is farther than another cell's farthest one is left. Dense places get
deep cells, empty ones none at all, and a query far from all targets costs no more than one among them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import observed, written

#: Targets of a leaf.
LEAF = 64
#: Levels at most: 4 ** 15 cells a side are finer than coordinates in one region differ. Cells of the last level are leaves whatever they hold.
_LEVELS = 15
#: Cells of a level (rows of seven numbers) that are broadcast; more are exchanged.
_SENT = 200_000
_BOX = ("x0", "y0", "x1", "y1")


def _finite(value: Column) -> Column:
    """False for null, NaN (which Spark orders last) and infinite values."""
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def _few(cells: DataFrame, n: int) -> DataFrame:
    return F.broadcast(cells) if n <= _SENT else cells


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by columns in which a null equals a null; the left's columns and the right's others."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return left.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]), how).drop(*[f"_r_{c}" for c in on])


def _tree(targets: DataFrame, extent: tuple[float, float, float], keys: list[str], leaf: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The cells of each level with their number (keys, _cx, _cy, _leaf and the box), and the leaves' targets (_level, _cx, _cy)."""
    low_x, low_y, side = extent
    levels, ended, left = [], [], targets
    for level in range(1, _LEVELS + 1):  # the first one has up to 16 cells a key
        scale, last = 4.0**level / side, 4**level - 1
        cell = [F.least(F.floor((F.col(m) - low) * scale), F.lit(last)).cast("long").alias(c) for m, low, c in (("_mx", low_x, "_cx"), ("_my", low_y, "_cy"))]
        placed = left.select(*targets.columns, *cell)
        box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
        counted = placed.groupBy(*keys, "_cx", "_cy").agg(F.count("*").alias("_n"), *box)
        marked = counted.withColumn("_leaf", (F.col("_n") <= leaf) | F.lit(level == _LEVELS)).drop("_n")
        cells, seen = observed(marked, "cells", F.count("*").alias("n"), F.count_if(~F.col("_leaf")).alias("divided"))
        n, divided = seen["n"], seen["divided"]
        levels.append((cells, n))
        # a divided cell may hold all targets: adaptive execution splits such a partition, as the other side has one row for it
        told = _same(placed, _few(cells.select(*keys, "_cx", "_cy", "_leaf"), n), [*keys, "_cx", "_cy"])
        told = told.select(*targets.columns, "_leaf", F.lit(level).alias("_level"), "_cx", "_cy")
        if not divided:
            return levels, reduce(DataFrame.unionByName, [*ended, told.drop("_leaf")])
        if divided < n:  # the targets of leaves are done
            parts = written(told, "targets") if level % 3 == 0 else told
            ended.append(parts.where("_leaf").drop("_leaf"))
            left = parts.where("not _leaf").select(*targets.columns)
    raise AssertionError("the last level has leaves only")


def nearest_boxes(queries: DataFrame, query_id: str, x: str, y: str, targets: DataFrame, target_id: str, measure: Callable[[Column, Column], Column], keys: list[str] | None = None, out: str = "distance", leaf: int = LEAF) -> DataFrame:
    """keys, query_id, target_id, ``out``: each query's nearest target of its keys, the least id on ties.

    Targets have a box (columns x0, y0, x1, y1) that they touch or fill; ``measure`` gives the distance (or its square) of a place (x, y) and
    a target from the target's columns. Queries or targets without a place (null, NaN or infinite) have no neighbour, and queries of keys without targets give no row. Keys that are
    null equal each other. Of rows with the same query id and keys the nearest counts. A cell is left only where it can't hold the nearest.
    """
    keys = keys or []
    boxed = targets.where(reduce(lambda a, b: a & b, [_finite(F.col(c)) for c in _BOX]))
    others = [c for c in boxed.columns if c not in {*keys, *_BOX, target_id}]
    # targets of the same shape are one, with the least id
    items = boxed.groupBy(*keys, *_BOX, *others).agg(F.min(target_id).alias("target_id"))
    items = items.withColumns({"_mx": F.col("x0") / 2 + F.col("x1") / 2, "_my": F.col("y0") / 2 + F.col("y1") / 2})
    items, seen = observed(items, "targets", *[f(c).alias(f"{n}{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("_mx", "_my")])
    asked = queries.select(*keys, F.col(query_id).alias("_query"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    asked = asked.where(_finite(F.col("_x")) & _finite(F.col("_y"))).distinct()
    done = [*keys, F.col("_query").alias(query_id), "target_id", out]
    if seen["least_mx"] is None:
        nothing = F.lit(None).cast(items.schema["target_id"].dataType).alias("target_id")
        return asked.select("*", nothing, F.lit(None).cast("double").alias(out)).where("false").select(*done)
    extent = seen["least_mx"], seen["least_my"], max(seen["most_mx"] - seen["least_mx"], seen["most_my"] - seen["least_my"]) or 1.0
    levels, placed = _tree(items, extent, keys, leaf)

    dx, dy = (F.greatest(F.lit(0.0), F.col(a) - F.col(p), F.col(p) - F.col(b)) for a, p, b in (("x0", "_x", "x1"), ("y0", "_y", "y1")))
    far_x, far_y = (F.greatest(F.abs(F.col(p) - F.col(a)), F.abs(F.col(b) - F.col(p))) for a, p, b in (("x0", "_x", "x1"), ("y0", "_y", "y1")))
    cell, who = ["_cx", "_cy", "_leaf", *_BOX], [*keys, "_query", "_x", "_y"]

    def bounded(rows: DataFrame) -> DataFrame:
        """Without the cells that another one of the query's rules out; the margin covers what the distance rounds."""
        rows = rows.withColumns({"_low": dx * dx + dy * dy, "_high": far_x * far_x + far_y * far_y}).withColumn("_most", F.min("_high").over(Window.partitionBy(*who)))
        return rows.where(F.col("_low") <= F.col("_most") * (1 + 1e-9) + 1e-300).drop("_low", "_high", "_most")

    top, n = levels[0]
    met = _same(asked, _few(top, n), keys) if keys else asked.crossJoin(F.broadcast(top))  # without keys 16 cells at most
    front = bounded(met.select(*who, F.lit(1).alias("_level"), *cell))
    for level, (cells, n) in enumerate(levels[1:], 2):
        # a divided cell gives way to its parts, a leaf has none and stays
        parts = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.shiftright("_cx", 2).alias("_px"), F.shiftright("_cy", 2).alias("_py"), F.lit(level).alias("_next"), *[F.col(c).alias(f"_n{c}") for c in cell])
        same = (F.col("_level") + 1 == F.col("_next")) & (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        deeper = front.join(_few(parts, n), same, "left")
        chosen = [F.when(F.col("_next").isNotNull(), F.col(f"_n{c}")).otherwise(F.col(c)).alias(c) for c in cell]
        front = bounded(deeper.select(*who, F.coalesce("_next", "_level").alias("_level"), *chosen))
    met = _same(front.select(*who, "_level", "_cx", "_cy"), placed, [*keys, "_level", "_cx", "_cy"])
    best = met.groupBy("_query", *keys).agg(F.min(F.struct(measure(F.col("_x"), F.col("_y")).alias("d"), F.col("target_id"))).alias("_best"))
    return best.select(*keys, "_query", F.col("_best.target_id").alias("target_id"), F.col("_best.d").alias(out)).select(*done)


def nearest_point(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str, x: str, y: str, leaf: int = LEAF) -> DataFrame:
    """query_id, target_id, d2: the nearest target by squared distance, the least id on ties (see ``nearest_boxes``)."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    points = targets.select(target_id, px.alias("x0"), py.alias("y0"), px.alias("x1"), py.alias("y1"))
    square = lambda qx, qy: (qx - F.col("x0")) * (qx - F.col("x0")) + (qy - F.col("y0")) * (qy - F.col("y0"))
    return nearest_boxes(queries, query_id, x, y, points, target_id, square, out="d2", leaf=leaf)


def nearest_segment(queries: DataFrame, query_id: str, x: str, y: str, segments: DataFrame, segment_id: str, keys: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """keys, query_id, target_id, distance: the nearest segment (columns x0, y0, x1, y1) of the query's keys, the least id on ties."""
    from .geo import segment_distance

    ends = [F.col(c).cast("double") for c in _BOX]
    (ax, ay, bx, by), wanted = ends, [*(keys or []), segment_id]
    boxed = segments.select(*wanted, F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"), *[c.alias(f"_s{i}") for i, c in enumerate(ends)])
    measure = lambda qx, qy: segment_distance(qx, qy, *[F.col(f"_s{i}") for i in range(4)])
    return nearest_boxes(queries, query_id, x, y, boxed, segment_id, measure, keys, leaf=leaf)
