"""Detectors with a lookup table, pairs of a series, filters of aligned curves, scene plans and cluster splits against NumPy and plain loops."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from swathlab.operators import detectors, joins, physics, sampling, select


def test_lookup_branch(spark):
    rng = np.random.default_rng(3)
    bands = np.round(rng.uniform(0.05, 1.0, (40, 4)), 3)
    rows = spark.createDataFrame([(i % 3, i, *map(float, b)) for i, b in enumerate(bands)] + [(7, 99, 0.0, 1.0, 0.0, None)], "image int, px int, a double, b double, ar double, br double")
    xs, ys = [-0.77, -0.4, -0.1, 0.0], [-0.61, -0.35, -0.08, 0.0]
    table = spark.createDataFrame([*zip(xs, ys, strict=True), (None, 1.0)], "frac double, value double")
    found = {r["px"]: r for r in detectors.baseline_detectors(rows, ["image"], "a", "b", "ar", "br", table).collect()}
    plain = {r["px"]: r for r in detectors.baseline_detectors(rows, ["image"], "a", "b", "ar", "br").collect()}
    assert len(found) == 41 and set(found[99].asDict()) == set(plain[99].asDict())
    for i, (a, b, ar, br) in enumerate(bands):
        t = (bands[:, 1] - bands[:, 0]) / bands[:, 0]
        r = (bands[:, 3] - bands[:, 2]) / bands[:, 2]
        same = np.arange(40) % 3 == i % 3
        c, m = np.median((bands[:, 1] / bands[:, 3])[same]), np.median(np.round(t / r, 9)[same])
        for name, raw in (("sbmp", (b - c * br) / (c * br)), ("mbsp", t[i]), ("mbmp", (t[i] - m * r[i]) / (m * r[i]))):
            regular = 0.0 if raw > 0 else -0.6149 if raw < -0.7715 else raw
            assert found[i][name] == pytest.approx(np.interp(regular, xs, ys), abs=1e-6)
            assert plain[i][name] == pytest.approx(0.0 if raw > 0 else max(raw, -0.7715), abs=1e-6)
        assert found[i]["zero"] == 0.0
    with pytest.raises(ValueError):
        detectors.baseline_detectors(rows, ["image"], "a", "b", "ar", "br", table.limit(0))


def test_pairs_of_a_series(spark):
    rng = np.random.default_rng(4)
    series = {s: rng.normal(size=(n, 6)) for s, n in ((1, 4), (2, 1), (3, 2))}
    rows = spark.createDataFrame([(s, i, v.tolist()) for s, vs in series.items() for i, v in enumerate(vs)] + [(4, 0, None), (4, 1, [1.0]), (5, 1, [1.0]), (5, 1, [2.0]), (6, 0, [1.0, None]), (6, 1, [3.0, 4.0])], "series int, day int, raster array<double>")
    for adjusted in (True, False):
        found = {(r["series"], r["newer"], r["older"]): r["change"] for r in detectors.pairwise_changes(rows, ["series"], "day", "raster", adjusted).collect()}
        expected = {(s, b, a) for s, vs in series.items() for a, b in itertools.combinations(range(len(vs)), 2)}
        assert set(found) == expected | {(4, 1, 0), (6, 1, 0)}
        for s, b, a in expected:
            change = series[s][b] - series[s][a]
            assert np.allclose(found[s, b, a], change - change.mean() if adjusted else change)
        assert found[4, 1, 0] is None and found[6, 1, 0] == ([0.0, None] if adjusted else [2.0, None])


def test_global_filter_of_aligned_curves(spark):
    rng = np.random.default_rng(6)
    grid = np.arange(8) / 2
    values = {n: rng.uniform(0.1, 1, (2, 8)) for n in ("srf", "solar", "a", "b")}
    curve = {n: spark.createDataFrame([(int(b), float(w), float(v[b, i])) for b in range(2) for i, w in enumerate(grid)], "band int, w double, v double") for n, v in values.items()}
    amounts = {"a": 0.5, "b": 2.0}
    species = [physics.absorbing_filter(curve[n], "v", x) for n, x in amounts.items()]
    found = physics.global_filter(curve["srf"], curve["solar"], species, [1.0, 2.3], "band", "w", "v")
    through = np.exp(-values["a"] * 0.5 - values["b"] * 2.0)
    for r in found.collect():
        product = values["srf"] * values["solar"] * through ** r["gamma"]
        assert r["v"] == pytest.approx(product[r["band"], int(r["w"] * 2)] / product[r["band"]].sum())
    assert found.count() == 32
    assert physics.global_filter(curve["srf"], curve["solar"], [], [1.0], "band", "w", "v").count() == 16
    twice = curve["a"].union(curve["a"].where("w = 1 AND band = 0"))
    for other in (curve["a"].where("w <> 1"), twice, curve["a"].withColumn("v", F.when(F.col("w") != 1, F.col("v"))), curve["a"].union(spark.createDataFrame([(0, 99.0, 1.0)], "band int, w double, v double"))):
        with pytest.raises(PySparkException):
            joins.aligned_curves({"x": curve["srf"], "y": other}, ["band", "w"], "v").collect()


def test_scene_plan(spark):
    rows = spark.createDataFrame([("t", 1, 0.0, 5.0), ("t", 1, 5.0, 10.0), ("u", 1, None, 5.0), ("u", 2, 0.0, 5.0)], "tile string, day int, low double, high double")
    assert sorted(map(tuple, select.scene_plan(rows, ["tile", "day"], 20).collect())) == [(0.0, 20.0, "t", 1), (0.0, 20.0, "u", 1), (0.0, 20.0, "u", 2)]
    assert sorted(map(tuple, select.scene_plan(rows, ["tile", "day"], 20, ("low", "high")).collect())) == [(0.0, 5.0, "t", 1), (0.0, 5.0, "u", 2), (5.0, 10.0, "t", 1)]


def test_cluster_split(spark):
    rng = np.random.default_rng(8)
    points = np.round(np.concatenate([rng.normal(c, 0.6, (40, 2)) for c in ((0, 0), (6, 1), (2, 7), (9, 9))]), 4)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(1000, None, 1.0), (1001, float("nan"), 1.0)], "id int, x double, y double")
    k, seed, rounds = 5, 3, 20
    order = sorted(range(len(points)), key=lambda i: (hashlib.sha256(f"{i}|{seed}".encode()).hexdigest(), i))[:k]
    centres = points[order]
    for _ in range(rounds):
        which = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.round(points[which == i].mean(axis=0), 9) if (which == i).any() else centres[i] for i in range(k)])
    which = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    first = sorted(range(k), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())[:2]
    found = {r["id"]: (r["cluster"], r["side"]) for r in sampling.cluster_split(rows, "id", ["x", "y"], k, 2, seed, rounds).collect()}
    assert found == {i: (int(c), "train" if c in first else "val") for i, c in enumerate(which)}
    assert sampling.cluster_split(rows.limit(0), "id", ["x", "y"], k, 2, seed, rounds).count() == 0
    assert {r["cluster"] for r in sampling.cluster_split(rows.where("id < 3"), "id", ["x", "y"], k, 2, seed, rounds).collect()} == {0, 1, 2}


def test_brightness_of_a_grid_that_is_exchanged(spark, monkeypatch):
    """Small and large grids give the same table, that of NumPy."""
    rng = np.random.default_rng(9)
    sigma, weight = rng.uniform(0, 1, 30), rng.uniform(0, 1, 30)
    spectra = spark.createDataFrame([(float(i), float(s), float(w)) for i, (s, w) in enumerate(zip(sigma, weight, strict=True))], "w double, s double, f double")
    scenes = spark.createDataFrame([(i, None if i == 6 else 2.0 + i % 3) for i in range(7)], "scene int, gamma double")
    conc = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "conc double")
    for limit in (500_000, 10):
        monkeypatch.setattr(physics, "GRID_LIMIT", limit)
        found = {(r["scene"], r["conc"]): r["nb"] for r in physics.brightness_table(spectra, scenes, conc, "s", "f", "gamma", "w", "scene").collect()}
        expected = {(i, c): (weight * np.exp(-(2.0 + i % 3) * c * sigma)).sum() for i in range(6) for c in (0.0, 0.5, 2.0)}
        assert set(found) == set(expected) and all(found[k] == pytest.approx(v) for k, v in expected.items())
