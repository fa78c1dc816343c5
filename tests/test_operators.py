"""Known answers, properties and brute force for operators that SQL on the tables shows less of."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathlab.functions import scalar as S
from swathlab.operators import aggregate, curves, interp, joins, nearest, physics, plumes, sampling, select
from swathlab.sources import io


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


def test_wind_and_emission_answers(spark):
    assert one(spark, S.wind_speed("u", "v"), u=3.0, v=4.0) == 5.0
    for u, v, d in ((0.0, 1.0, 0), (1.0, 0.0, 90), (0.0, -1.0, 180), (-1.0, 0.0, -90)):
        assert one(spark, S.wind_direction("u", "v"), u=u, v=v) == pytest.approx(d)
    assert one(spark, S.effective_wind("w", F.col("w") * 0.9, F.col("w") * 1.1)["eff"], w=2.0) == pytest.approx(0.6787, abs=1e-4)
    assert one(spark, S.emission_rate("u", "l", "m"), u=2.0, l=50.0, m=1000.0) == pytest.approx(2310.1144)
    low, high = S.error_bounds("w", 0.1)
    assert one(spark, F.struct(low, high), w=10.0) == (pytest.approx(9), pytest.approx(11))


def test_gamma(spark):
    assert one(spark, S.gamma("a", "b"), a=0.0, b=0.0) == pytest.approx(2)
    assert one(spark, S.gamma("a", "b"), a=45.0, b=45.0) == pytest.approx(2.8284271)
    for a, b in ((-1.0, 45.0), (45.0, 91.0)):
        with pytest.raises(Exception, match="angles"):
            one(spark, S.gamma("a", "b"), a=a, b=b)


def test_area_length_ime(spark):
    retrieval = [[0, 0.01, 0.10], [0.05, 0.03, 0.02]]
    rows = spark.createDataFrame([(1, r, c, v) for r, line in enumerate(retrieval) for c, v in enumerate(map(float, line))], "chip int, row int, col int, v double")
    found = plumes.area_length_ime(rows, ["chip"], "v", 20.0).first()
    assert (found["area"], found["length"], found["ime"]) == (2000, pytest.approx(44.72136), pytest.approx(84))


def test_brightness_table(spark):
    """conc [1, 2], sigma scaled so that exp(-sigma * c) is as in the known answer: two wavelengths of weight 1."""
    spectra = spark.createDataFrame([(1.0, 0.05983, 1.0), (2.0, 0.11966, 1.0)], "wavelength double, sigma double, w double")
    scenes = spark.createDataFrame([(7, 1.0)], "scene int, gamma double")
    conc = spark.createDataFrame([(1.0,), (2.0,)], "conc double")
    found = {r["conc"]: r["nb"] for r in physics.brightness_table(spectra, scenes, conc, "sigma", "w", "gamma", "wavelength", "scene").collect()}
    assert found == {c: pytest.approx(math.exp(-0.05983 * c) + math.exp(-0.11966 * c)) for c in (1.0, 2.0)}


def test_signal_to_noise(spark):
    rows = spark.createDataFrame([(1.0, True), (0.0, False), (1.0, False)], "p double, t boolean").withColumn("k", F.lit(1))
    assert aggregate.signal_to_noise(rows, ["k"], F.col("p"), F.col("t")).first()["snr"] == pytest.approx(2.0)
    flat = spark.createDataFrame([(1.0, True), (0.5, False)], "p double, t boolean").withColumn("k", F.lit(1))
    assert aggregate.signal_to_noise(flat, ["k"], F.col("p"), F.col("t")).first()["snr"] is None


def test_rates_are_null_when_undefined(spark):
    counts = spark.createDataFrame([(0, 0, 0, 0), (0, 3, 0, 0), (0, 0, 2, 0), (1, 0, 0, 1)], "tp long, tn long, fp long, fn long")
    rows = aggregate.rates(counts).collect()
    assert rows[0]["f1"] is None and rows[1]["precision"] is None and rows[1]["fpr"] == 0
    assert rows[2]["f1"] == 0 and rows[2]["precision"] == 0 and rows[3]["recall"] == 0.5


@pytest.mark.parametrize("sizes", [(0, 5), (1, 1), (3, 4000), (1, 100_000)])
def test_merged_states_equal_the_whole(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    values = [rng.normal(i, 1 + i, n) for i, n in enumerate(sizes)]
    states = [(1, len(v), float(v.mean()), float(v.var())) for v in values if len(v)]
    found = aggregate.merge_states(spark.createDataFrame(states, "k int, n long, mean double, var double"), ["k"]).first()
    whole = np.concatenate(values)
    assert (found["n"], found["mean"], found["var"]) == (len(whole), pytest.approx(whole.mean(), abs=1e-7), pytest.approx(whole.var(), abs=1e-7))


def test_nan_is_missing(spark):
    assert one(spark, S.clean("x"), x=float("nan")) is None


def test_newest_tier_one_granule(spark):
    rows = [("LC08", "d1", "T2", "20220110", "a"), ("LC08", "d1", "T1", "20220105", "b"), ("LC08", "d1", "T1", "20220108", "c"), ("LC09", "d1", "T2", "20220101", "d"), ("LC09", "d1", "T2", "20220103", "e"), ("LC08", "d2", "T1", "20220201", "f")]
    scenes = spark.createDataFrame(rows, "sensor string, date string, category string, processed string, id string")
    assert sorted(r["id"] for r in select.best_granules(scenes, ["sensor", "date"], "category", "processed", "id").collect()) == ["c", "e", "f"]


def flood(mask, strong):
    """Components of a mask that hold a strong pixel, by flood fill; labels as the operator numbers them."""
    height, width = mask.shape
    labels = np.zeros(mask.shape, int)
    for r in range(height):
        for c in range(width):
            if mask[r, c] and not labels[r, c]:
                stack, cells = [(r, c)], []
                labels[r, c] = -1
                while stack:
                    y, x = stack.pop()
                    cells.append((y, x))
                    for v in range(max(0, y - 1), min(height, y + 2)):
                        for u in range(max(0, x - 1), min(width, x + 2)):
                            if mask[v, u] and not labels[v, u]:
                                labels[v, u] = -1
                                stack.append((v, u))
                good = any(strong[p] for p in cells)
                for p in cells:
                    labels[p] = r * width + c + 1 if good else -2
    return np.maximum(labels, 0)


@pytest.mark.parametrize("size", [1, 5, 32])
def test_hysteresis_against_flood_fill(size):
    rng = np.random.default_rng(size)
    p = rng.random((20, size, size))
    p[0] = 0
    p[1] = 1
    if size == 32:  # a snake: the longest way through a raster
        p[2] = 0
        p[2, ::2] = 0.9
        p[2, 1::4, -1] = p[2, 3::4, 0] = 0.9
    found = plumes.hysteresis_labels(p, 0.95, 0.6)
    for a, b in zip(found, p, strict=True):
        assert np.array_equal(a, flood(b >= 0.6, b >= 0.95))


def test_interpolation_forms_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    xs = np.sort(rng.choice(np.arange(100), 20, replace=False)).astype(float)
    ys, at = rng.normal(size=20), rng.uniform(-10, 110, 200)
    expected = np.interp(at, xs, ys)
    queries = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(at)] + [(2, 999, 1.0)], "k int, i int, x double")
    knots = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(xs, ys, strict=True)], "k int, kx double, ky double")
    rows = {r["i"]: r["y"] for r in interp.interpolate_join(queries, knots, ["k"], "x", "kx", "ky", "y").collect()}
    assert rows.pop(999) is None and np.allclose([rows[i] for i in range(200)], expected)
    arrays = queries.where("k = 1").select("i", interp.interpolate_array(F.col("x"), F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys)))).alias("y"))
    rows = {r["i"]: r["y"] for r in arrays.collect()}
    assert np.allclose([rows[i] for i in range(200)], expected)
    grid = np.linspace(0, 100, 21)
    table = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate(np.sin(grid))], "k int, i int, v double")
    rows = {r["i"]: r["y"] for r in interp.interpolate_uniform(queries.where("k = 1"), table, ["k"], "x", 0.0, 5.0, 21, "v", "y").collect()}
    assert np.allclose([rows[i] for i in range(200)], np.interp(at, grid, np.sin(grid)))


def test_lookup_round_trip(spark):
    table = spark.range(101).select(F.col("id").cast("double").alias("conc"), (F.exp(-F.col("id") / 40) - 1).alias("frac"))
    rows = spark.range(101).select("id", (F.exp(-F.col("id") / 40) - 1).alias("frac"))
    found = physics.reverse_lookup(rows, table, "frac", "conc")
    assert all(abs(r["conc"] - r["id"]) < 1e-9 for r in found.collect())


def test_threshold_for_rate(spark):
    t = [round(0.1 * i, 1) for i in range(1, 10)]
    curve = spark.createDataFrame([(r, x, y * f) for r, f in (("a", 0.5), ("b", 1.5)) for x, y in zip(t, [50, 30, 20, 12, 8, 5, 3, 2, 0], strict=True)], "region string, threshold double, per_tile double")
    found = {r["rate"]: r["threshold"] for r in curves.threshold_for_rate(curve, [1, 10, 40, 100]).collect()}
    expected = np.round(np.interp([1, 10, 40, 100], [50, 30, 20, 12, 8, 5, 3, 2, 0][::-1], t[::-1]) * 10, 3)
    assert [found[float(r)] for r in (1, 10, 40, 100)] == pytest.approx(list(expected))


def test_emission_grid():
    grid = curves.emission_grid()
    assert len(grid) == 29 and grid[0] == 100 and grid[-1] == 25000


def test_nearest_point_far_and_tied(spark):
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, -700.0), (3, 5.0, 5.0)], "q int, x double, y double")
    targets = spark.createDataFrame([(10, 1.0, 0.0), (11, -1.0, 0.0), (12, 5.0, 6.0)], "t int, x double, y double")
    found = {r["q"]: r["target_id"] for r in nearest.nearest_point(queries, "q", targets, "t", "x", "y").collect()}
    assert found == {1: 10, 2: 10, 3: 12}
    assert nearest.nearest_point(queries, "q", targets.where("false"), "t", "x", "y").count() == 0


def test_splits_are_disjoint_and_stable(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 40).alias("tile"))
    sides = sampling.split(rows, ["tile"], {"train": 0.6, "val": 0.4}).groupBy("tile").agg(F.countDistinct("side").alias("n"))
    assert sides.where("n <> 1").count() == 0
    again = sampling.split(rows.repartition(9), ["id"], {"a": 0.5}).where("side = 'a'")
    assert again.exceptAll(sampling.split(rows, ["id"], {"a": 0.5}).where("side = 'a'")).count() == 0


def test_oversampling_fills_quotas(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(100)], "s string, id long")
    wanted = spark.createDataFrame([("a", 24), ("b", 30)], "s string, quota long")
    found = {r["s"]: (r["n"], r["m"]) for r in sampling.stratified(rows, "s", "id", wanted, "x").groupBy("s").agg(F.sum("copies").alias("n"), F.max("copies").alias("m")).collect()}
    assert found == {"a": (24, 4), "b": (30, 1)}


def test_aligned_product_refuses_other_grids(spark):
    a = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "w double, v double")
    assert sorted(r["v"] for r in joins.aligned_product(a, a, "w", "v").collect()) == [4, 9]
    with pytest.raises(Exception, match="grids"):
        joins.aligned_product(a, a.where("w = 1"), "w", "v").collect()


def test_raster_bytes(spark):
    values = [[1.5, -2.0, 0.25, 8.0], None]
    rows = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(values)], "id int, raster array<double>, extra string")
    back = io.decode_rasters(io.encode_rasters(rows, "raster", "<f4"), "raster", "<f4", (1, 2, 2)).orderBy("id").collect()
    assert [r["raster"] for r in back] == values and back[0]["extra"] == "kept"
    with pytest.raises(Exception, match="not 12 bytes"):
        io.decode_rasters(io.encode_rasters(rows, "raster", "<f4"), "raster", "<f4", (3,)).collect()


def test_two_references(spark):
    times = [datetime(2024, 1, d) for d in (1, 5, 9, 20)]
    scenes = spark.createDataFrame([(i, "t", t, float(i == 1) * 90) for i, t in enumerate(times)], "granule_id int, tile string, acquired timestamp, cloud double")
    rows = select.reference_pairs(scenes, F.col("cloud") < 30, days=30).collect()
    assert [(r["main"], r["before"], r["earlier"]) for r in rows] == [(3, 2, 0)]


def test_dates_of_one_format(spark):
    """A column's format is told from all its rows; mixed or other formats are an error."""
    given = lambda *texts: spark.createDataFrame([(t,) for t in texts], "day string")
    for texts in (("2024/03/01", "2023/12/31", None), ("2024-3-1", "2023-12-31", None)):
        assert [str(r["out"]) for r in io.parse_dates(given(*texts), "day", "out").collect()] == ["2024-03-01", "2023-12-31", "None"]
    for texts in (("2024/03/01", "2024-03-01"), ("01/03/2024",), ("2024-02-30",)):
        with pytest.raises(ValueError, match="no format"):
            io.parse_dates(given(*texts), "day", "out")
    assert io.parse_dates(given(), "day", "out").count() == 0


def test_least_detectable_rate(spark):
    """The rate of the least probability above 0.01, though a lower rate has a larger one."""
    curve = spark.createDataFrame([("r", 100, 5.0), ("r", 200, 0.005), ("r", 300, 2.0), ("r", 400, 60.0), ("r", 500, 95.0), ("none", 100, 0.0)], "region string, rate int, pod double")
    found = {r["region"]: r for r in curves.pod_levels(curve, ["region"], "rate", "pod").collect()}
    assert found["r"]["minimum"] == 300 and found["r"]["pod10"] == 300 and found["r"]["pod50"] == round(100 + 300 * 45 / 55)
    assert found["none"]["minimum"] is None


def test_interpolation_of_one_curve(spark, monkeypatch):
    """The arrays in the row and the window give the same."""
    knots = spark.createDataFrame([(float(x), float(x * x)) for x in range(0, 20, 2)], "x double, y double")
    rows = spark.createDataFrame([(i, i / 3 - 1) for i in range(80)] + [(99, None)], "i long, q double")
    small = {r["i"]: r["v"] for r in interp.interpolate_curve(rows, knots, "q", "x", "y", "v").collect()}
    monkeypatch.setattr(interp, "SMALL_CURVE", 1)
    large = {r["i"]: r["v"] for r in interp.interpolate_curve(rows, knots, "q", "x", "y", "v").collect()}
    assert small == pytest.approx(large) and small[99] is None and small[0] == 0.0
