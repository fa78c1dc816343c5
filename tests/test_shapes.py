"""Least rectangles and square neighbourhoods against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swathlab.functions import raster
from swathlab.operators import plumes


def corners(pixels):
    return np.array([(c + j, r + i) for r, c in pixels for i in (0, 1) for j in (0, 1)])


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20))
def test_least_rectangle_against_a_fine_grid_of_angles(pixels):
    points = corners(pixels)
    longer, shorter = plumes.least_rectangle(points)
    angle = np.radians(np.arange(0, 90, 0.01))
    u = points[:, :1] * np.cos(angle) + points[:, 1:] * np.sin(angle)
    v = points[:, 1:] * np.cos(angle) - points[:, :1] * np.sin(angle)
    areas = np.ptp(u, axis=0) * np.ptp(v, axis=0)
    assert longer >= shorter > 0 and longer * shorter <= areas.min() + 1e-6 and areas.min() <= longer * shorter * 1.01 + 1e-9
    hull = plumes.hull(points)
    for (x0, y0), (x1, y1) in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        assert ((x1 - x0) * (points[:, 1] - y0) - (y1 - y0) * (points[:, 0] - x0) >= 0).all()


def test_major_axis_of_a_diagonal(spark):
    rows = [("d", i, i) for i in range(10)] + [("row", 3, c) for c in range(7)] + [("one", 0, 0)]
    found = {r["k"]: r["length"] for r in plumes.major_axis(spark.createDataFrame(rows, "k string, row int, col int"), ["k"]).collect()}
    assert found == {"d": pytest.approx(10 * np.sqrt(2)), "row": pytest.approx(7), "one": pytest.approx(1)}


@pytest.mark.parametrize("reach", [0, 1, 2, 9])
def test_running_squares(spark, reach):
    rng, size, height = np.random.default_rng(2), 6, 5
    given_ = [[None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 50, size * height)] for _ in range(4)]
    masks = [[None if rng.random() < 0.1 else bool(v) for v in rng.random(size * height) < 0.8] for _ in range(4)]
    rows = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(given_, masks, strict=True))] + [(9, None, None), (8, [], [])], "i int, v array<double>, m array<boolean>")
    found = {r["i"]: r for r in rows.select("i", raster.running("v", size, reach).alias("high"), raster.running("v", size, reach, False).alias("low"), raster.dilate("m", size, reach).alias("wide"), raster.erode("m", size, reach).alias("narrow"), raster.set_pixels("m", size).alias("at")).collect()}
    assert found[9]["high"] is None and found[8]["high"] == [] == found[8]["narrow"]
    for i, (values, mask) in enumerate(zip(given_, masks, strict=True)):
        for p in range(size * height):
            r, c = divmod(p, size)
            square = [y * size + x for y in range(max(0, r - reach), min(height, r + reach + 1)) for x in range(max(0, c - reach), min(size, c + reach + 1))]
            known = [values[k] for k in square if values[k] is not None]
            assert (found[i]["high"][p], found[i]["low"][p]) == (max(known, default=None), min(known, default=None))
            assert found[i]["wide"][p] == any(mask[k] for k in square)
            assert found[i]["narrow"][p] == (len(square) == (2 * reach + 1) ** 2 and all(mask[k] for k in square))
        assert [(x["row"], x["col"]) for x in found[i]["at"]] == [divmod(p, size) for p in range(size * height) if mask[p]]


def test_rows_and_columns_without_signal_go(spark):
    nan = float("nan")
    given_ = [([0, 0, 0, 0, 1, 0, 2, 0, 0, 0, 0, 0, 3, 0, nan, 0], 4), ([0.0] * 6, 3), ([nan, None, 0.1, 5.0], 2), ([], 2), (None, 2)]
    for values, width in given_:
        rows = spark.createDataFrame([(None if values is None else [None if v is None else float(v) for v in values],)], "v array<double>")
        found = rows.select(raster.keep_signal("v", width, 0.5).alias("k")).first()["k"]
        if not values:
            assert found is None
            continue
        grid = np.array([np.nan if v is None else v for v in values]).reshape(-1, width)
        cut = grid[(grid > 0.5).any(axis=1)][:, (grid > 0.5).any(axis=0)]
        assert (found["height"], found["width"]) == ((grid > 0.5).any(axis=1).sum(), (grid > 0.5).any(axis=0).sum())
        assert np.allclose([np.nan if v is None else v for v in found["values"]], cut.ravel(), equal_nan=True)
    plan = spark.createDataFrame([([1.0],)], "v array<double>").select(F.explode(raster.running("v", 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_chips_are_labelled_in_slices(spark):
    """A batch of many chips is labelled a slice at a time (null ones too), with the rows of one pass over all."""
    rng = np.random.default_rng(8)
    rasters = [None if i % 97 == 0 else rng.random(64).tolist() for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["chip"])
    parts = [b.column(0).to_pylist() for b in plumes.slices(iter([batch]), 64)]
    assert max(map(len, parts)) * 64 <= plumes.SLICE and sum(parts, []) == list(range(2500))
    assert [b.num_rows for b in plumes.slices(iter([batch.slice(0, 3)]), 2 * plumes.SLICE)] == [1, 1, 1]
    values = [None if i % 89 == 0 else [float(64 * i + k) for k in range(64)] for i in range(2500)]
    chips = spark.createDataFrame(list(zip(range(2500), rasters, values, strict=True)), "chip long, raster array<double>, value array<double>").coalesce(1)
    found = {(r["chip"], r["row"], r["col"]): (r["label"], r["value"]) for r in plumes.label_chips(chips, "chip", "raster", 8, 0.9, 0.7, values=("value",)).collect()}
    labels = plumes.hysteresis_labels(np.array([[-1.0] * 64 if r is None else r for r in rasters]).reshape(-1, 8, 8), 0.9, 0.7)
    which = np.argwhere(labels)
    assert found == {(i, r, c): (labels[i, r, c], None if values[i] is None else values[i][8 * r + c]) for i, r, c in which.tolist()}
