"""Running values over ordered series of any length: sums, the row before, the last and next known value.

A window over a key sorts the whole series in one task. A series of more than ``HELD`` rows is cut into slices instead: the rows are
range-partitioned by key and order, each slice is scanned by itself, and what a slice needs from those around it (its carry: a total,
the last known value) comes from one small row per slice. A slice continues one key at most, so carries are as few as slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

#: Rows of a series that one task sorts; also the rows of a slice.
HELD = 200_000


class Series:
    """Rows with keys and a total order (columns, ascending, nulls first), cut into slices where a key has more than ``held`` rows.

    Rows that agree in key and order stay in one slice, so give an order that tells rows apart.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], held: int = HELD):
        self.keys, self.order, self.rows, self.cut = keys, order, rows, False
        n, most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
        if most is not None and most > held:
            # written, so that all scans see the same slices
            sliced = rows.repartitionByRange(math.ceil(n / held), *keys, *order).withColumn("_slice", F.spark_partition_id())
            self.rows, self.cut = written(sliced, "slices"), True

    def _within(self, first: int, last: int) -> Window:
        slices = ["_slice"] if self.cut else []
        return Window.partitionBy(*self.keys, *slices).orderBy(*self.order).rowsBetween(first, last)

    def _carried(self, per_slice: Column, over: Column) -> DataFrame:
        """For each slice that has a key's rows beyond it: the slice, the key and the carry."""
        totals = self.rows.groupBy(*self.keys, "_slice").agg(per_slice.alias("_part"))
        return totals.select(F.col("_slice").alias("_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], over.alias("_carry")).where("_carry is not null")

    def _with(self, out: str, local: Column, per_slice: Column, backward: bool, combine) -> Series:
        rows = self.rows.withColumn(out, local)
        if self.cut:
            around = Window.partitionBy(*self.keys).orderBy("_slice")
            over = combine[0](around.rowsBetween(1, Window.unboundedFollowing) if backward else around.rowsBetween(Window.unboundedPreceding, -1))
            carry = self._carried(per_slice, over)
            same = F.col("_slice") == F.col("_of")
            for i, k in enumerate(self.keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            rows = rows.join(carry, same, "left").withColumn(out, combine[1](F.col(out), F.col("_carry"))).drop("_of", "_carry", *[f"_k{i}" for i in range(len(self.keys))])
        made = object.__new__(Series)
        made.keys, made.order, made.rows, made.cut = self.keys, self.order, rows, self.cut
        return made

    def total(self, value: Column, out: str) -> Series:
        """The sum of the key's values up to and with the row (null while there is none)."""
        added = lambda own, before: F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0)))
        return self._with(out, F.sum(value).over(self._within(Window.unboundedPreceding, 0)), F.sum(value), False, (lambda w: F.sum("_part").over(w), added))

    def last(self, value: Column, out: str) -> Series:
        """The value of the last row before this one that has one (isn't null)."""
        known = F.last(value, ignorenulls=True).over(self._within(Window.unboundedPreceding, -1))
        return self._known(known, F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))), out, False)

    def next(self, value: Column, out: str) -> Series:
        """The value of the first row behind this one that has one (isn't null)."""
        known = F.first(value, ignorenulls=True).over(self._within(1, Window.unboundedFollowing))
        return self._known(known, F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order))), out, True)

    def _known(self, local: Column, per_slice: Column, out: str, backward: bool) -> Series:
        near = lambda w: (F.first if backward else F.last)("_part", ignorenulls=True).over(w)
        return self._with(out, local, per_slice, backward, (near, lambda own, beyond: F.coalesce(own, beyond)))

    def before(self, value: Column, out: str) -> Series:
        """The value of the row before this one, null in a key's first row."""
        held = self.last(F.struct(value.alias("v")), out)
        held.rows = held.rows.withColumn(out, F.col(out)["v"])
        return held

    def result(self) -> DataFrame:
        return self.rows.drop("_slice") if self.cut else self.rows


def told_apart(rows: DataFrame) -> Column:
    """A number from a row's values (maps aside), to order rows of the same time by."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])


def gaps(rows: DataFrame, keys: list[str], time: str, tie: str, out: str, held: int = HELD) -> DataFrame:
    """``rows`` with the seconds since the reading before; null in a series' first row."""
    at = rows.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    found = Series(at, keys, ["_at", tie], held).before(F.col("_at"), "_past").result()
    return found.withColumn(out, (F.col("_at") - F.col("_past")) / 1e6).drop("_at", "_past")


def spans(rows: DataFrame, keys: list[str], time: str, tie: str, held: int = HELD) -> DataFrame:
    """keys, start (microseconds), duration and largest gap (both in seconds; a series of one reading has no gap)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    found = gaps(rows.select(*keys, time, tie), keys, time, tie, "gap", held)
    return found.groupBy(*keys).agg(F.min(at).alias("start"), ((F.max(at) - F.min(at)) / 1e6).alias("duration"), F.max("gap").alias("largest"))


def cumulative_position(rows: DataFrame, keys: list[str], time: str, tie: str, speed: str, out: str, held: int = HELD) -> DataFrame:
    """``rows`` with the distance covered since the series' first reading: speed times the seconds since the reading before, summed."""
    at = rows.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    series = Series(at, keys, ["_at", tie], held).before(F.col("_at"), "_past")
    step = F.col(speed) * F.coalesce((F.col("_at") - F.col("_past")) / 1e6, F.lit(0.0))
    return series.total(step, out).result().drop("_at", "_past")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_id: str, held: int = HELD) -> DataFrame:
    """``left`` with the id of the last row of ``right`` strictly before it, as ``matched`` (the least id of that time). No pairs are made.

    Rows of ``right`` without a time serve none, rows of ``left`` without one match none.
    """
    a = left.select("*", F.col(left_time).alias("_time"), F.lit(0).alias("_side"), told_apart(left).alias("_tie"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"))
    b = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("_time")).agg(F.min(right_id).alias("_id"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    series = Series(a.unionByName(b, allowMissingColumns=True), keys, ["_time", "_side", "_tie"], held)
    return series.last(F.col("_id"), "matched").result().where("_side = 0").select(*[F.col(f"`{c}`") for c in left.columns], "matched")
