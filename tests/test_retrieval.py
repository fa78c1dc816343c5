"""Knot index, component tree, brightness of all bands and the one-scan report, against NumPy and brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swathlab.functions import scalar as S
from swathlab.operators import curves, interp, physics, plumes


@pytest.mark.parametrize("kind", ["even", "random", "clustered", "two", "one", "many"])
def test_knot_index_is_numpy_interp(spark, kind):
    rng = np.random.default_rng(5)
    xs = {"even": np.linspace(-3, 9, 101), "random": np.sort(rng.normal(size=37)), "clustered": np.sort(np.concatenate([rng.uniform(0, 1e-6, 400), [5.0, 1e6]])), "two": np.array([1.0, 2.0]), "one": np.array([4.0]), "many": np.sort(rng.uniform(-50, 50, 1000))}[kind]
    ys = rng.normal(size=len(xs))
    at = np.concatenate([xs, (xs[:-1] + xs[1:]) / 2, rng.uniform(xs[0] - 1, xs[-1] + 1, 500), [-1e9, 1e9]])
    knots = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys, strict=True)], "x double, y double")
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(at)] + [(-1, None)], "i int, x double")
    found = interp.interpolate_curve(rows, knots, "x", "x", "y", "y")
    assert found.columns == ["i", "x", "y"] and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    values = {r["i"]: r["y"] for r in found.collect()}
    assert values.pop(-1) is None
    assert np.allclose([values[i] for i in range(len(at))], np.interp(at, xs, ys), rtol=1e-9, atol=1e-9)


def test_knot_index_repeated_knots_and_nothing(spark):
    knots = spark.createDataFrame([(0.0, 0.0), (1.0, 5.0), (1.0, 7.0), (1.0, 6.0), (2.0, 0.0), (None, 3.0)], "x double, y double")
    rows = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 1.5)], "i int, at double")
    assert {r["i"]: r["y"] for r in interp.interpolate_curve(rows, knots, "at", "x", "y", "y").collect()} == {0: 2.5, 1: 7.0, 2: 3.5}
    assert {r["y"] for r in interp.interpolate_curve(rows, knots.limit(0), "at", "x", "y", "y").collect()} == {None}


def test_knot_index_steps_are_few():
    assert interp.KnotIndex([(float(i), 0.0) for i in range(1000)]).steps == 1
    assert interp.KnotIndex([(float(i) ** 9, 0.0) for i in range(1000)]).steps <= 10


@pytest.mark.parametrize(("size", "levels"), [(32, None), (32, 6), (7, 3)])
def test_component_tree_gives_the_labels_of_every_pair(size, levels):
    """Every (marker, floor) of one tree is the direct labelling; ties of values too."""
    rng = np.random.default_rng(size)
    for _ in range(4):
        raster = rng.random((size, size))
        if levels:
            raster = np.floor(raster * levels) / levels
        tree = plumes.ComponentTree(raster, 0.4)
        for floor in (0.4, 0.5, 0.5001, 0.66, 0.9, 1.5):
            for marker in (floor, 0.7, 0.95, 0.999):
                labels = plumes.hysteresis_labels(raster[None], marker, floor)[0]
                assert sorted(tree.component_pixels(marker, floor)) == np.flatnonzero(labels.ravel()).tolist()
                assert tree.component_area(marker, floor) == (labels > 0).sum()
            node = tree.nodes(floor)
            direct = plumes.hysteresis_labels(raster[None], floor, floor)[0].ravel()
            assert (tree.first[node] + 1 == direct[tree.pixels[: len(node)]]).all()
            for n in set(node.tolist()):
                inside = direct == tree.first[n] + 1
                assert tree.area[n] == inside.sum() and tree.top[n] == raster.ravel()[inside].max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=25, max_size=25), st.integers(0, 4), st.integers(0, 4))
def test_component_tree_small(cells, floor, more):
    raster = np.array(cells, float).reshape(5, 5)
    labels = plumes.hysteresis_labels(raster[None], floor + more, floor)[0]
    assert sorted(plumes.ComponentTree(raster, 0.0).component_pixels(floor + more, floor)) == np.flatnonzero(labels.ravel()).tolist()


PAIRS = [(0.9, 0.6), (0.8, 0.5), (0.99, 0.3), (0.5, 0.5)]


def test_pixel_recall_counts_pixels_of_components(spark):
    """Plumes over several chips, with null rasters, NaN pixels, plumes without pixels, and a marker outside of the plume."""
    rng, size, n = np.random.default_rng(3), 12, 3
    chips = []
    for i in range(30):
        raster = rng.random(size * size)
        raster[rng.integers(size * size)] = np.nan
        marks = [int(m) if m < n else None for m in rng.integers(0, 5, size * size)]
        if i == 0:
            marks = [None] * (size * size)
        chips.append((i, i % 2, None if i == 1 else [float(v) for v in raster], marks))
    table = spark.createDataFrame([(c, r, v, m, "kept") for c, r, v, m in chips], "chip int, region int, v array<double>, mark array<int>, _raster string")
    hits = plumes.component_hits(table, ("region", "chip"), "v", "mark", n, size, PAIRS)
    found = {(r["chip"], r["plume"]): (r["n"], r["hits"]) for r in hits.collect()}
    recalls = defaultdict(list)
    for c, region, v, marks in chips:
        raster = np.full((size, size), -np.inf) if v is None else np.nan_to_num(np.array(v), nan=-np.inf).reshape(size, size)
        which = np.array([-1 if m is None else m for m in marks])
        shares = defaultdict(list)
        for plume in range(n):
            own = which == plume
            expected = []
            for marker, floor in PAIRS:
                labels = plumes.hysteresis_labels(raster[None], marker, floor)[0].ravel()
                expected.append(int((labels[own] > 0).sum()) if own.any() and raster.ravel()[own].max() >= marker else 0)
            assert found[c, plume] == (own.sum(), expected)
            for k, hit in enumerate(expected):
                if own.any():
                    shares[k].append(hit / own.sum())
        for k in range(len(PAIRS)):
            recalls[region, k].append(np.mean(shares[k]) if shares[k] else 0.0)
    rows = curves.pixel_recall(hits, ["region"], "chip", PAIRS).collect()
    assert len(rows) == 2 * len(PAIRS)
    for r in rows:
        values = recalls[r["region"], PAIRS.index((r["marker"], r["floor"]))]
        assert math.isclose(r["mean"], 100 * np.mean(values), abs_tol=1e-9) and math.isclose(r["std"], 100 * np.std(values), abs_tol=1e-9)
    areas = curves.false_positive_area(table, "v", size, "region", PAIRS, 2.0).collect()
    for r in areas:
        own = [np.nan_to_num(np.array(v), nan=-np.inf).reshape(size, size) for c, g, v, _ in chips if g == r["region"] and v is not None]
        total = sum((plumes.hysteresis_labels(x[None], r["marker"], r["floor"]) > 0).sum() for x in own)
        assert math.isclose(r["fp_px"], 2.0 * total / sum(g == r["region"] for _, g, _, _ in chips))


def test_brightness_of_all_bands_is_the_interpolation_of_logarithms(spark):
    grid = [1e-3, 0.01, 0.1, 1.0, 10.0]
    logs = {1: [-0.002, -0.02, -0.1, -0.5, -2.0], 2: [-1e-7, -2e-7, -5e-7, -6e-7, -9e-7], 7: [-0.1, -0.2, -0.3, -0.4, -0.5]}
    table = physics.BandTable(spark.createDataFrame([(b, g, y) for b, ys in logs.items() for g, y in zip(grid, ys, strict=True)] + [(b, 0.0, 0.0) for b in logs], "band int, gc double, log_nb double"))
    assert table.bands == [1, 2, 7] and table.sensitive == [True, False, True]
    at = [0.0, 1e-5, 1.1e-5, 1e-3, 0.005, 0.1, 0.7, 9.0, 10.0, 99.0, -1.0, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i int, gc double")
    found = {r["i"]: r["nb"] for r in table.brightness(rows, "gc", "nb").collect()}
    for i, x in enumerate(at):
        for k, (b, ys) in enumerate(logs.items()):
            absorbed = np.log(-np.expm1(ys))
            expected = 1.0 if x is None or x <= 1e-5 or b == 2 else -np.expm1(np.interp(np.log(x), np.log(grid), absorbed))
            assert math.isclose(found[i][k], expected, rel_tol=1e-12), (x, b)
    with pytest.raises(ValueError):
        physics.BandTable(spark.createDataFrame([(1, 1.0, -0.1), (2, 2.0, -0.1)], "band int, gc double, log_nb double"))


def report_rows():
    rng = random.Random(8)
    rows = []
    for chip in range(40):
        emission = rng.choice([0, 0, 50, 100, 101, 300, 700, 5000])
        for _ in range(rng.randint(1, 60)):
            rows.append((chip % 3, chip, float(emission), rng.choice([None, rng.random(), 0.5]) if chip == 7 else rng.random(), rng.random() < 0.2, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 2)))
    return rows


def test_report_from_one_histogram(spark):
    rows = report_rows()
    pixels = spark.createDataFrame(rows, "region int, chip int, emission double, prob double, truth boolean, pred double, target double, v double").repartition(4)
    columns = [F.col(c) for c in ("emission",)] + [F.col("emission") == 0, F.col("prob"), F.col("truth"), F.col("pred"), F.col("target"), S.bce_with_logits("v", F.col("truth").cast("double"))]
    histogram = curves.score_histogram(pixels, "region", "chip", *columns)
    assert histogram.count() <= 512 * 40
    thresholds, limit = [0.1 * k for k in range(1, 10)], 12.0
    level = lambda p: None if p is None else round(p * 255)
    above = lambda p, t: p is not None and level(p) > t * 255
    chips = defaultdict(list)
    for r in rows:
        chips[r[:3]].append(r)
    means = []
    for t in thresholds:
        per = defaultdict(list)
        for (region, _, e), px in chips.items():
            if e == 0:
                per[region].append(sum(above(p[3], t) for p in px))
        means.append(np.mean([np.mean(v) for v in per.values()]))
    k = next((i for i, m in enumerate(means) if m < limit), None)
    at = thresholds[-1] if k is None else thresholds[0] if k == 0 else thresholds[k - 1] + (limit - means[k - 1]) / (means[k] - means[k - 1]) * (thresholds[k] - thresholds[k - 1])
    assert math.isclose(curves.false_positive_threshold(histogram, "region", "chip", thresholds, limit).first()["threshold"], at)
    report = {r["region"]: r for r in curves.validation_report(histogram, "region", "chip", thresholds, limit).collect()}
    assert set(report) == {0, 1, 2, None}
    bin_of = lambda e: None if e <= 0 else next((i for i, x in enumerate(curves.EMISSION_BINS) if e <= x), 6)
    recalls = {}
    for region in (0, 1, 2, None):
        own = {key: px for key, px in chips.items() if region in (None, key[0])}
        px = [p for x in own.values() for p in x]
        tp, fp = sum(above(p[3], at) and p[4] for p in px), sum(above(p[3], at) and not p[4] for p in px)
        fn, tn = sum(p[4] for p in px) - tp, sum(not p[4] for p in px) - fp
        r = report[region]
        assert (r["tp"], r["tn"], r["fp"], r["fn"], r["chips"]) == (tp, tn, fp, fn, len(own)) and math.isclose(r["f1"], 2 * tp / (2 * tp + fp + fn))
        noise = np.std([p[5] for p in px if not p[4]])
        assert math.isclose(r["snr"], np.mean([p[5] for p in px if p[4]]) / noise, rel_tol=1e-9) and math.isclose(r["mse"], sum((p[5] - p[6]) ** 2 for p in px) / len(own))
        bce = sum(max(p[7], 0) - p[7] * p[4] + math.log1p(math.exp(-abs(p[7]))) for p in px)
        cond = sum((p[5] - p[6]) ** 2 for p in px if p[4])
        assert math.isclose(r["bce"], bce / len(own)) and math.isclose(r["cond_mse"], cond / len(own)) and math.isclose(r["loss"], (bce + cond) / len(own))
        if region is not None:
            each = defaultdict(list)
            for (_, _, e), ps in own.items():
                hit = sum(above(p[3], at) and p[4] for p in ps)
                each[bin_of(e)].append(100 * hit / (sum(p[4] for p in ps) + 0.00001))
            recalls[region] = [np.mean(each[i]) if each[i] else 0.0 for i in range(7)]
            assert np.allclose(r["recalls"], recalls[region]) and math.isclose(r["recall"], np.mean(recalls[region]))
    assert np.allclose(report[None]["recalls"], np.mean(list(recalls.values()), axis=0)) and math.isclose(report[None]["recall"], np.mean(list(recalls.values())))


def test_report_merges_and_handles_no_plumes(spark):
    """Summaries of halves give the report of the whole; undefined rates are null."""
    rows = [(0, 1, 0.0, 0.2, False, 0.5, 0.1, 0.3), (0, 1, 0.0, None, False, 0.5, 0.1, 0.3), (0, 2, 0.0, 0.9, False, 0.5, 0.1, -0.3)]
    schema = "region int, chip int, emission double, prob double, truth boolean, pred double, target double, v double"
    columns = [F.col("emission"), F.col("emission") == 0, F.col("prob"), F.col("truth"), F.col("pred"), F.col("target"), S.bce_with_logits("v", F.col("truth").cast("double"))]
    parts = [curves.score_histogram(spark.createDataFrame(x, schema), "region", "chip", *columns) for x in (rows[:1], rows[1:], rows)]
    merged, whole = (curves.validation_report(h, "region", "chip", [0.1, 0.5], 0.4).collect() for h in (parts[0].unionByName(parts[1]), parts[2]))
    assert sorted(map(str, merged)) == sorted(map(str, whole))
    first = next(r for r in whole if r["region"] == 0)
    assert first["pixel_recall"] is None and first["snr"] is None and first["recalls"] == [0.0] * 7 and first["fp"] + first["tn"] == 3
