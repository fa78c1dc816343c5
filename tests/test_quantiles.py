"""Exact quantiles of large groups against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathlab.operators import quantiles

SHARES = [0.0, 0.005, 0.3, 0.5, 0.995, 1.0]


def groups():
    rng = np.random.default_rng(6)
    return {
        "even": rng.permutation(20_000).astype(float), "wide": np.sign(rng.normal(size=9000)) * 10.0 ** rng.uniform(-200, 200, 9000), "ties": rng.integers(0, 3, 12_000).astype(float), "one": np.full(8000, 7.25),
        "two": np.concatenate([np.zeros(5000), np.ones(5001)]), "near": 1 + rng.integers(0, 4000, 9000) * 2.0**-50, "few": np.array([3.0, 1.0, 2.0, 10.0]), "single": np.array([4.0]),
    }


@pytest.mark.parametrize("held", [50, 700, 10**6])
def test_quantiles_are_numpy_s(spark, held):
    given = groups()
    rows = [(k, float(v)) for k, values in given.items() for v in values] + [("few", None), ("none", None), (None, 5.0), (None, 6.0)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(6)
    found = {r["k"]: r["q"] for r in quantiles.exact_quantiles(table, ["k"], F.col("v"), SHARES, "q", held).collect()}
    assert set(found) == {*given, "none", None} and found["none"] is None and np.allclose(found[None], np.quantile([5.0, 6.0], SHARES))
    for k, values in given.items():
        assert np.allclose(found[k], np.quantile(values, SHARES), rtol=1e-12, atol=0), k


def test_hot_group_is_not_held_by_a_task(spark):
    """A group of a million rows: no cell that is picked from has more than the bound, and there are few rounds."""
    rows = spark.range(1_000_000, numPartitions=8).select((F.col("id") % 3).alias("one"), F.when(F.col("id") % 100 < 98, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v"))
    values = {}
    for r in rows.groupBy("k").agg(F.collect_list("v").alias("v")).collect():
        values[r["k"]] = np.quantile(r["v"], [0.005, 0.5, 0.995])
    found = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(rows, ["k"], F.col("v"), [0.005, 0.5, 0.995], held=2000).collect()}
    assert set(found) == set(values) and all(np.allclose(found[k], values[k], rtol=1e-12) for k in values)
    hot = rows.where("k = 'hot'").select(F.struct("k").alias("_key"), F.col("v").alias("_v"))
    n = hot.count()
    state = spark.createDataFrame([("hot", k, n) for k in (n // 200, n // 2, n - 1)], "k string, _k long, _n long").select(F.struct("k").alias("_key"), "_k", "_n", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(0).cast("long").alias("_below"))
    sizes = [n]
    while max(sizes) > 2000:
        state = quantiles.written(quantiles._counted(quantiles._bracket(state, hot), hot), "test")
        cells = [r["_in"] for r in state.collect()]
        assert max(cells) <= max(2000, max(sizes) / 20)
        sizes = cells


def test_quantiles_without_keys_or_rows(spark):
    table = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    for held in (10, 1000):
        assert quantiles.exact_quantiles(table, [], F.col("v"), [0.25, 0.5], held=held).first()["quantiles"] == [25.0, 50.0]
    assert quantiles.exact_quantiles(table.limit(0), ["v"], F.col("v"), [0.5]).count() == 0
    nan = spark.createDataFrame([(1.0,), (float("nan"),)] * 20, "v double")
    assert quantiles.exact_quantiles(nan, [], F.col("v"), [0.25], held=5).first()["quantiles"] == [1.0]
