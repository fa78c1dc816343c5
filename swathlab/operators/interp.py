"""Linear interpolation of queries between knots, clamped at both ends.

Of knots with equal x the right-most one at or below the query counts (the one with the largest y among equals).
Four forms: a window over knots and queries together (any size), an index for uniform grids,
a guide table over the knots (one curve of a bounded length), and arrays of knots in the row.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interpolate
from .series import HELD, Series, told_apart


def interpolate_join(queries: DataFrame, knots: DataFrame, keys: list[str], at: str, x: str, y: str, out: str, held: int = HELD) -> DataFrame:
    """``queries`` with the value at ``at`` of their key's knots (columns x, y); null for a key without knots.

    Knots and queries are united and each query takes the last knot before and the first one behind it. One sort and no pairs; long
    series are scanned in slices (see ``series``). A knot without x doesn't count.
    """
    columns = [F.col(f"`{c}`") for c in queries.columns]
    a = queries.select("*", F.col(at).cast("double").alias("_x"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_y"), told_apart(queries).alias("_tie"))
    b = knots.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_asks"), F.col(y).cast("double").alias("_y"), F.lit(0).cast("long").alias("_tie"))
    point = F.when(F.col("_asks") == 0, F.struct("_x", "_y"))
    both = Series(a.unionByName(b, allowMissingColumns=True), keys, ["_x", "_asks", "_y", "_tie"], held)
    found = both.last(point, "_l").next(point, "_r").result().where("_asks = 1")
    left, right = F.coalesce("_l", "_r"), F.coalesce("_r", "_l")
    value = interpolate(F.col("_x"), left["_x"], left["_y"], right["_x"], right["_y"])
    return found.select(*columns, F.when(F.col("_x").isNotNull(), value).alias(out))


#: Knots that go with the plan as constants; more are met by a window.
SMALL_CURVE = 1000
#: Cells of the guide table for each knot.
_CELLS = 2


class KnotIndex:
    """A guide table over the sorted knots of one curve: how many knots lie below each of equal cells.

    A place's cell bounds the number of knots at or below it, and bisection between the bounds finds it: one or two steps
    where knots lie evenly, the logarithm of their number at worst. Place and knots get their cell by the same increasing
    arithmetic, so the bounds are exact whatever it rounds. Repeated knots, and up to any number of them in a cell, are allowed.
    """

    def __init__(self, knots: list[tuple[float, float | None]]):
        # a missing value comes first among equal places, as Spark sorts it
        pairs = sorted(((float(x), y) for x, y in knots), key=lambda k: (k[0], k[1] is not None, k[1] or 0.0))
        self.xs, self.ys = [x for x, _ in pairs], [None if y is None else float(y) for _, y in pairs]
        span = self.xs[-1] - self.xs[0]
        self.cells = _CELLS * len(pairs)
        self.scale = self.cells / span if span > 0 else 0.0
        counts = [0] * (self.cells + 1)
        for x in self.xs:
            counts[min(int((x - self.xs[0]) * self.scale), self.cells - 1) + 1] += 1
        self.guide = list(itertools.accumulate(counts))
        self.steps = max(counts).bit_length()

    def value(self, rows: DataFrame, at: str, out: str) -> DataFrame:
        """``rows`` with the curve's value at a column of doubles, clamped; null where that is null.

        Each step is a column of its own, computed once a row within generated code; the tables are constants.
        """
        xs, ys, guide = (F.lit(v) for v in (self.xs, [float("nan") if y is None else y for y in self.ys], self.guide))
        cell = F.greatest(F.least(F.floor((F.col(at) - F.lit(self.xs[0])) * F.lit(self.scale)), F.lit(self.cells - 1)), F.lit(0)).cast("int")
        found = rows.withColumn("_cell", cell).withColumns({"_low": F.get(guide, F.col("_cell")), "_high": F.get(guide, F.col("_cell") + 1)})
        for _ in range(self.steps):
            found = found.withColumn("_mid", F.shiftright(F.col("_low") + F.col("_high") + 1, 1))
            found = found.withColumn("_less", (F.col("_low") < F.col("_high")) & (F.get(xs, F.col("_mid") - 1) <= F.col(at)))
            found = found.withColumns({"_low": F.when(F.col("_less"), F.col("_mid")).otherwise(F.col("_low")), "_high": F.when(F.col("_less") | (F.col("_low") >= F.col("_high")), F.col("_high")).otherwise(F.col("_mid") - 1)})
        n = len(self.xs)
        found = found.withColumn("_i", F.least(F.greatest("_low", F.lit(1)), F.lit(max(1, n - 1))))
        found = found.withColumns({"_x0": F.get(xs, F.col("_i") - 1), "_y0": F.get(ys, F.col("_i") - 1), "_x1": F.get(xs, F.col("_i")), "_y1": F.get(ys, F.col("_i"))})
        known = lambda y: F.when(~F.isnan(y), y)
        first, last = F.lit(self.ys[0]).cast("double"), F.lit(self.ys[-1]).cast("double")
        inside = interpolate(F.col(at), F.col("_x0"), known(F.col("_y0")), F.col("_x1"), known(F.col("_y1")))
        value = F.when(F.col(at) <= self.xs[0], first).when(F.col(at) >= self.xs[-1], last).otherwise(inside)
        return found.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], F.when(F.col(at).isNotNull(), value).alias(out))


def interpolate_curve(queries: DataFrame, knots: DataFrame, at: str, x: str, y: str, out: str, parts: int | None = None) -> DataFrame:
    """``queries`` with the value at ``at`` of one curve for all rows.

    A curve of up to ``SMALL_CURVE`` knots becomes a ``KnotIndex``, and nothing is exchanged. A longer one is
    given to each of ``parts`` parts of the queries (by default as many as there are shuffle partitions), see ``interpolate_join``.
    """
    few = knots.where(F.col(x).isNotNull()).select(F.col(x).cast("double"), F.col(y).cast("double")).limit(SMALL_CURVE + 1).collect()
    if not few:
        return queries.withColumn(out, F.lit(None).cast("double"))
    if len(few) <= SMALL_CURVE:
        place = "_at"
        found = KnotIndex([(r[0], r[1]) for r in few]).value(queries.withColumn(place, F.col(at).cast("double")), place, out)
        return found.select(*[F.col(f"`{c}`") for c in queries.columns if c != out], out)
    parts = parts or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = queries.withColumn("_part", F.pmod(F.xxhash64(*queries.columns), F.lit(parts)).cast("int"))
    each = knots.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return interpolate_join(split, each, ["_part"], at, x, y, out).drop("_part")


def interpolate_uniform(queries: DataFrame, knots: DataFrame, keys: list[str], at: str, start: float, step: float, n: int, y: str, out: str) -> DataFrame:
    """The same on a grid ``start + i * step`` (i from 0 to n - 1; knots have columns i and y): two equi-joins on the index."""
    place = F.least(F.greatest((F.col(at) - start) / step, F.lit(0.0)), F.lit(float(n - 1)))
    q = queries.withColumn("_p", place).withColumn("_i", F.least(F.floor("_p"), F.lit(n - 2)).cast("int"))
    pairs = knots.select(*keys, F.col("i").cast("int").alias("_i"), F.col(y).alias("_y0"))
    nxt = knots.select(*keys, (F.col("i") - 1).cast("int").alias("_i"), F.col(y).alias("_y1"))
    found = q.join(pairs.join(nxt, [*keys, "_i"]), [*keys, "_i"], "left")
    return found.select(*queries.columns, (F.col("_y0") + (F.col("_p") - F.col("_i")) * (F.col("_y1") - F.col("_y0"))).alias(out))


def interpolate_array(at: Column, xs: Column, ys: Column) -> Column:
    """The same for sorted arrays of knots in the row."""
    n = F.size(xs)
    below = F.greatest(F.size(F.filter(xs, lambda k: k <= at)), F.lit(1))
    i = F.least(below, n - 1)
    x0, y0, x1, y1 = F.element_at(xs, i), F.element_at(ys, i), F.element_at(xs, i + 1), F.element_at(ys, i + 1)
    inside = interpolate(at, x0, y0, x1, y1)
    return F.when(at <= F.element_at(xs, 1), F.element_at(ys, 1)).when(at >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inside)
