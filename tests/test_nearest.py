"""Nearest points and segments against NumPy, dense cells and far queries among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from swathlab.operators import nearest

rng = np.random.default_rng(12)


def places():
    """Clusters of very different density, one line, repeated places, and a lone one far away."""
    parts = [rng.uniform(-50, 50, (300, 2)), rng.normal(0, 1e-3, (400, 2)), 30 + rng.normal(0, 1e-7, (300, 2)), np.column_stack([np.full(200, -20.0), rng.uniform(0, 90, 200)]), np.repeat([[7.0, 7.0]], 100, 0), [[1e6, -1e6]]]
    return np.concatenate(parts)


@pytest.mark.parametrize("leaf", [4, 5000])
def test_points_at_any_density(spark, leaf):
    targets = places()
    asked = np.concatenate([rng.uniform(-60, 60, (80, 2)), targets[::37], rng.normal(0, 1e-3, (40, 2)), 30 + rng.normal(0, 1e-7, (40, 2)), [[7.0, 7.0], [-1e7, 1e7], [5e5, -5e5]]])
    q = spark.createDataFrame(pd.DataFrame({"q": range(len(asked)), "x": asked[:, 0], "y": asked[:, 1]}))
    t = spark.createDataFrame(pd.DataFrame({"t": rng.permutation(len(targets)), "x": targets[:, 0], "y": targets[:, 1]}))
    ids = np.array([r["t"] for r in t.collect()])
    found = {r["q"]: (r["target_id"], r["d2"]) for r in nearest.nearest_point(q, "q", t, "t", "x", "y", leaf).collect()}
    assert len(found) == len(asked)
    for i, (x, y) in enumerate(asked):
        d2 = (x - targets[:, 0]) * (x - targets[:, 0]) + (y - targets[:, 1]) * (y - targets[:, 1])
        assert found[i] == (ids[d2 == d2.min()].min(), d2.min())


def test_rows_without_a_place_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    q = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 9.0), (1, 9.0, 9.0), (2, None, 1.0), (3, nan, 1.0), (4, 1.0, inf), (None, 5.0, 5.0)], "q int, x double, y double")
    t = spark.createDataFrame([(10, 3.0, 0.0), (11, 9.0, 8.0), (12, None, 0.0), (13, nan, 0.0), (14, inf, 0.0), (None, 5.0, 5.5)], "t int, x double, y double")
    found = {r["q"]: (r["target_id"], r["d2"]) for r in nearest.nearest_point(q, "q", t, "t", "x", "y").collect()}
    assert found == {1: (11, 1.0), None: (None, 0.25)}
    assert nearest.nearest_point(q, "q", t.where("t > 11"), "t", "x", "y").columns == ["q", "target_id", "d2"] and nearest.nearest_point(q, "q", t.where("t > 11"), "t", "x", "y").count() == 0
    assert nearest.nearest_point(q.where("false"), "q", t, "t", "x", "y").count() == 0


@pytest.mark.parametrize("leaf", [2, 32])
def test_segments_by_key(spark, leaf):
    ends = np.concatenate([rng.uniform(0, 20, (150, 2)), rng.uniform(0, 20, (150, 2))], axis=1)
    ends[100:, 2:] = ends[100:, :2] + rng.normal(0, 1e-4, (50, 2))
    ends[0] = [-500, -500, 500, 500]
    ends[1, 2:] = ends[1, :2]
    keys = [None if i % 3 == 2 else i % 3 for i in range(150)]
    s = spark.createDataFrame([(k, i, *map(float, e)) for i, (k, e) in enumerate(zip(keys, ends, strict=True))], "k int, s int, x0 double, y0 double, x1 double, y1 double")
    asked = rng.uniform(-30, 40, (120, 2))
    groups = [(0, 1, None, 7)[i % 4] for i in range(120)]
    q = spark.createDataFrame([(i, k, *map(float, p)) for i, (k, p) in enumerate(zip(groups, asked, strict=True))], "q int, k int, x double, y double")
    found = {r["q"]: r for r in nearest.nearest_segment(q, "q", "x", "y", s, "s", ["k"], leaf).collect()}
    assert sorted(found) == [i for i in range(120) if groups[i] != 7]  # a key without segments gives no row
    for i, row in found.items():
        mine = [j for j in range(150) if keys[j] == groups[i]]
        a, b, p = ends[mine, :2], ends[mine, 2:], asked[i]
        length = ((b - a) ** 2).sum(1)
        along = np.clip(np.divide(((p - a) * (b - a)).sum(1), length, out=np.zeros(len(mine)), where=length > 0), 0, 1)
        d = np.hypot(*(p - (a + along[:, None] * (b - a))).T)
        assert row["k"] == groups[i] and row["distance"] == pytest.approx(d.min(), abs=1e-9) and d[mine.index(row["target_id"])] == pytest.approx(d.min(), abs=1e-9)


def test_a_dense_place_stays_cheap(spark):
    """100,000 targets that any coarse cell holds together: each query meets a few leaves of them, from far away too."""
    targets = np.concatenate([rng.normal(0, 1e-2, (100_000, 2)), [[1000.0, 1000.0]]])
    asked = np.concatenate([rng.normal(0, 1e-2, (300, 2)), rng.uniform(-900, 900, (300, 2))])
    t = spark.createDataFrame(pd.DataFrame({"t": range(len(targets)), "x": targets[:, 0], "y": targets[:, 1]})).repartition(4)
    q = spark.createDataFrame(pd.DataFrame({"q": range(len(asked)), "x": asked[:, 0], "y": asked[:, 1]}))
    found = {r["q"]: r["target_id"] for r in nearest.nearest_point(q, "q", t, "t", "x", "y").collect()}
    for i in range(0, 600, 7):
        d2 = (asked[i, 0] - targets[:, 0]) ** 2 + (asked[i, 1] - targets[:, 1]) ** 2
        assert found[i] == d2.argmin()
    assert len(found) == 600
    boxes = t.selectExpr("t as target_id", "x as x0", "y as y0", "x as x1", "y as y1", "x as _mx", "y as _my")
    levels, placed = nearest._tree(boxes, (float(targets[:, 0].min()), float(targets[:, 1].min()), float(np.ptp(targets, axis=0).max())), [], nearest.LEAF)
    held = [r["count"] for r in placed.groupBy("_level", "_cx", "_cy").count().collect()]
    assert sum(held) == len(targets) and max(held) <= nearest.LEAF and len(levels) > 6
