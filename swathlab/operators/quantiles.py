"""Exact quantiles of groups of any size.

Spark's exact percentile holds all distinct values of a group in one buffer. That is kept for groups of up to ``HELD`` values.
Of larger ones the order statistics are selected: a mergeable sketch of the group gives cut values, the cell between two
cuts that has the wanted rank is found by exact counts, and cut further until it has few values, or one. Only sketches and
counts are exchanged, and the values of the last, small cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

#: Values that a task may hold of one group.
HELD = 100_000
#: Cells that a round cuts a group into, and the sketch's accuracy.
_CUTS, _ACCURACY = 128, 2560
_ROUNDS = 40


def _bracket(open_: DataFrame, hot: DataFrame) -> DataFrame:
    """The open ranks with a smaller range of values that, by the sketch, has them, and a value amid it."""
    cuts = F.percentile_approx("_v", [i / _CUTS for i in range(_CUTS + 1)], _ACCURACY)
    inside = hot.join(open_, "_key").where("_v >= _lo and _v <= _hi")
    cut = inside.groupBy("_key", "_k", "_n", "_lo", "_hi", "_below").agg(cuts.alias("_cuts"), F.count("*").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    place = (F.col("_k") - F.col("_below")) / F.col("_in") * _CUTS
    low, amid, high = (F.get("_cuts", (f + by).cast("int")) for f, by in ((F.floor(place), -1), (F.rint(place), 0), (F.floor(place), 2)))
    return cut.select(
        "_key", "_k", "_n", F.col("_least").alias("_old_lo"), F.col("_most").alias("_old_hi"), F.coalesce(amid, "_least").alias("_amid"),
        # beyond the sketch's ends stand the exact ones
        F.coalesce(F.when(place < 1, F.col("_least")), low, "_least").alias("_lo"), F.coalesce(F.when(place > _CUTS - 2, F.col("_most")), high, "_most").alias("_hi"),
    )


def _counted(brackets: DataFrame, hot: DataFrame) -> DataFrame:
    """The part of each bracket that has the rank, with exact counts of the values below and in it: the value amid it alone, those
    below it or those above it. A rank that the bracket misses goes to the side that has it (``_below`` null: not counted).

    The value amid is taken out each time, so that a few values that fill a group don't stay together.
    """
    v, amid = F.col("_v"), F.col("_amid")
    sides = hot.join(brackets, "_key").groupBy("_key", "_k", "_n", "_old_lo", "_old_hi", "_lo", "_hi", "_amid").agg(
        F.count_if(v < F.col("_lo")).alias("_b0"), F.count_if(v < amid).alias("_b1"), F.count_if(v <= amid).alias("_b2"), F.count_if(v <= F.col("_hi")).alias("_b3"),
        F.max(F.when((v < amid) & (v >= F.col("_lo")), v)).alias("_left"), F.min(F.when((v > amid) & (v <= F.col("_hi")), v)).alias("_right"),
    )
    k, none, n, b0, b1, b2, b3 = F.col("_k"), F.lit(None).cast("long"), *(F.col(c) for c in ("_n", "_b0", "_b1", "_b2", "_b3"))
    lo, hi, old_lo, old_hi, left_, right = (F.col(c) for c in ("_lo", "_hi", "_old_lo", "_old_hi", "_left", "_right"))
    cases = [
        (k < b0, old_lo, lo, none, n), (k >= b3, hi, old_hi, none, n), ((k >= b1) & (k < b2), amid, amid, b1, b2 - b1), (k < b1, lo, left_, b0, b1 - b0), (F.lit(True), right, hi, b2, b3 - b2),
    ]

    def chosen(at: int) -> Column:
        out = F.when(cases[0][0], cases[0][at])
        for case in cases[1:]:
            out = out.when(case[0], case[at])
        return out

    return sides.select("_key", "_k", "_n", chosen(1).alias("_lo"), chosen(2).alias("_hi"), chosen(3).alias("_below"), chosen(4).alias("_in"))


def _order_statistics(hot: DataFrame, ranks: DataFrame, held: int) -> DataFrame:
    """The value of each rank (from 0) of the large groups: _key, _k, _value. ``hot``: _key, _v; ``ranks``: _key, _n, _k."""
    infinite = float("inf")
    open_ = ranks.select("_key", "_k", "_n", F.lit(-infinite).alias("_lo"), F.lit(infinite).alias("_hi"), F.lit(0).cast("long").alias("_below"))
    found = []
    for _ in range(_ROUNDS):
        counted = written(_counted(_bracket(open_, hot), hot), "ranks")
        missed = counted.where("_below is null")
        if not missed.isEmpty():
            below = hot.join(missed, "_key").where("_v < _lo").groupBy("_key", "_k").agg(F.count("*").alias("_b"))
            counted = counted.join(below, ["_key", "_k"], "left").withColumn("_below", F.coalesce("_below", "_b", F.lit(0).cast("long"))).drop("_b")
        one, few = F.col("_lo") == F.col("_hi"), F.col("_in") <= held
        found.append(counted.where(one).select("_key", "_k", F.col("_lo").alias("_value")))
        small = hot.join(counted.where(~one & few), "_key").where("_v >= _lo and _v <= _hi")
        picked = small.withColumn("_at", F.row_number().over(Window.partitionBy("_key", "_k").orderBy("_v")) - 1 + F.col("_below")).where("_at = _k")
        found.append(picked.select("_key", "_k", F.col("_v").alias("_value")))
        open_ = counted.where(~one & ~few).drop("_in")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"ranks weren't found in {_ROUNDS} rounds")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: list[float], out: str = "quantiles", held: int = HELD) -> DataFrame:
    """keys, and an array of the exact quantiles of a numeric value at the shares (linear between order statistics).

    Nulls don't count, a group of nulls only has null; null keys are a group, and without keys all rows are one. NaN is
    above all numbers, as in Spark's own percentile. No task holds more than ``held`` values of a group.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    given = rows.select(key.alias("_key"), value.cast("double").alias("_v"))
    sizes = given.groupBy("_key").agg(F.count("_v").alias("_n"), F.max(F.isnan("_v")).alias("_nan"))
    large = written(sizes.where((F.col("_n") > held) & ~F.col("_nan")), "groups")
    plain = lambda part: part.groupBy("_key").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(out))
    if large.isEmpty():
        found = plain(given)
    else:
        ranks = large.withColumn("_r", F.explode(F.array(*[(F.col("_n") - 1) * F.lit(float(s)) for s in shares])))
        ranks = written(ranks.select("_key", "_n", F.explode(F.array(F.floor("_r"), F.ceil("_r"))).alias("_k")).distinct(), "ranks")
        hot = given.where("_v is not null").join(large.select("_key"), "_key")
        at = _order_statistics(hot, ranks, held).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_value"))).alias("_at"))

        def one(share: float) -> Column:
            r = (F.col("_n") - 1) * F.lit(float(share))
            low, high = F.col("_at")[F.floor(r)], F.col("_at")[F.ceil(r)]
            return low + (r - F.floor(r)) * (high - low)

        selected = at.join(large, "_key").select("_key", F.array(*[one(s) for s in shares]).alias(out))
        found = plain(given.join(large.select("_key"), "_key", "left_anti")).unionByName(selected)
    return found.select(*[F.col("_key")[k].alias(k) for k in keys], out)
