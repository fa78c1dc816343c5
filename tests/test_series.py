"""Running values in slices against plain loops: any cut gives the rows of a window over the whole series."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathlab.operators import interp, series

HELD = [13, 90, 10**6]


def readings():
    rng = np.random.default_rng(5)
    sizes = {"hot": 400, "warm": 37, "one": 1, None: 60, "": 5}
    rows = [(k, None if rng.random() < 0.03 else int(rng.integers(0, n)), None if rng.random() < 0.4 else float(rng.integers(-9, 9))) for k, n in sizes.items() for _ in range(n)]
    return [(i, *r) for i, r in enumerate(rows)]


def ordered(rows):
    """Rows by key, each in the order of time (null first) and id."""
    keyed = {}
    for r in rows:
        keyed.setdefault(r[1], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2] is not None, r[2] or 0, r[0])) for k, v in keyed.items()}


@pytest.mark.parametrize("held", HELD)
def test_scans(spark, held):
    given = readings()
    rows = spark.createDataFrame(given, "i int, k string, t int, v double").repartition(5)
    s = series.Series(rows, ["k"], ["t", "i"], held)
    assert s.cut == (held < 400)
    out = s.total(F.col("v"), "sum").last(F.col("v"), "last").next(F.col("v"), "next").before(F.col("v"), "before").result()
    assert out.columns == ["i", "k", "t", "v", "sum", "last", "next", "before"]
    found = {r["i"]: r for r in out.collect()}
    assert len(found) == len(given)
    for line in ordered(given).values():
        values = [r[3] for r in line]
        for n, r in enumerate(line):
            known, back, ahead = ([v for v in part if v is not None] for part in (values[: n + 1], values[:n], values[n + 1 :]))
            row = found[r[0]]
            assert row["sum"] == (sum(known) if known else None)
            assert (row["last"], row["next"], row["before"]) == (back[-1] if back else None, ahead[0] if ahead else None, values[n - 1] if n else None)


def test_slices_are_bounded(spark):
    """One key with nearly all rows: no slice has many more rows than asked for."""
    rows = spark.range(60_000).select(F.lit("hot").alias("k"), F.col("id").alias("t")).unionByName(spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("t"))).repartition(8)
    s = series.Series(rows, ["k"], ["t"], 2000)
    sizes = [r["count"] for r in s.rows.groupBy("k", "_slice").count().collect()]
    assert s.cut and sum(sizes) == 60_500 and max(sizes) <= 6000


@pytest.mark.parametrize("held", HELD)
def test_gaps_and_positions(spark, held):
    given = [(i, k, t, v) for i, k, t, v in readings() if t is not None and v is not None]
    rows = spark.createDataFrame(given, "i int, k string, t int, v double").withColumn("at", F.timestamp_seconds("t")).repartition(4)
    spans = {r["k"]: r for r in series.spans(rows, ["k"], "at", "i", held).collect()}
    far = {r["i"]: r["x"] for r in series.cumulative_position(rows, ["k"], "at", "i", "v", "x", held).collect()}
    assert len(far) == len(given)
    for k, line in ordered(given).items():
        times = [r[2] for r in line]
        steps = [b - a for a, b in itertools.pairwise(times)]
        assert (spans[k]["start"], spans[k]["duration"], spans[k]["largest"]) == (times[0] * 10**6, times[-1] - times[0], max(steps, default=None))
        assert [far[r[0]] for r in line] == pytest.approx(list(itertools.accumulate(r[3] * s for r, s in zip(line, [0, *steps], strict=True))))


@pytest.mark.parametrize("held", HELD)
def test_as_of(spark, held):
    given = readings()
    left = spark.createDataFrame(given, "i int, k string, t int, v double")
    right = left.where("v > 0").select("k", F.col("t").alias("u"), F.col("i").alias("ref"))
    found = {r["i"]: r["matched"] for r in series.as_of(left, right, ["k"], "t", "u", "ref", held).collect()}
    for i, k, t, _ in given:
        before = [(r[2], -r[0]) for r in given if r[1] == k and r[3] is not None and r[3] > 0 and r[2] is not None and t is not None and r[2] < t]
        assert found[i] == (-max(before)[1] if before else None)
    assert series.as_of(left, right.where("false"), ["k"], "t", "u", "ref", held).where("matched is null").count() == len(given)
    assert series.as_of(left.where("false"), right, ["k"], "t", "u", "ref", held).count() == 0


@pytest.mark.parametrize("held", HELD)
def test_interpolation_in_slices(spark, held):
    rng = np.random.default_rng(8)
    xs, at = np.sort(rng.choice(300, 60, replace=False)).astype(float), rng.uniform(-20, 320, 500)
    ys = rng.normal(size=60)
    queries = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(at)] + [("b", 900, 1.0), ("a", 901, None)], "k string, i int, x double").repartition(3)
    knots = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(xs, ys, strict=True)] + [("a", None, 4.0)], "k string, kx double, ky double")
    found = {r["i"]: r["y"] for r in interp.interpolate_join(queries, knots, ["k"], "x", "kx", "ky", "y", held).collect()}
    assert found.pop(900) is None and found.pop(901) is None and np.allclose([found[i] for i in range(500)], np.interp(at, xs, ys))
