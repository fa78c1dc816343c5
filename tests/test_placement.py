"""Placement of plumes against plain loops over places and pixels, and its awkward cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathlab.operators import placement as PL

HEIGHT, WIDTH = 11, 14
KEYS = "chip int, blocked array<boolean>, nodata array<boolean>"
LIBRARY = "plume_id long, height int, width int, values array<double>"


def key_of(seed, place):
    x = (seed + 48271 * (place + 1)) % (2**31 - 1)
    return x * x % (2**31 - 1)


def loops_by_source(clear, plume, seed):
    """The first place in the order of the keys, each tested by a loop over the plume's pixels."""
    for key, place in sorted((key_of(seed, p), p) for p in range(clear.size)):
        row, col = divmod(place, WIDTH)
        if not clear[row, col]:
            continue
        side = plume[:, ::-1] if key % 2 else plume
        cells = [(r, c, side[r, c]) for r in range(side.shape[0]) for c in range(side.shape[1]) if side[r, c] > 0]
        top = max(cells, key=lambda x: (x[2], -x[0], -x[1]))
        moved = [(row + r - top[0], col + c - top[1], m) for r, c, m in cells]
        inside = [(r, c, m) for r, c, m in moved if 0 <= r < HEIGHT and 0 <= c < WIDTH]
        if sum(m for r, c, m in inside if clear[r, c]) / sum(m for *_, m in moved) >= 0.8:
            return row, col, bool(key % 2), sorted((r * WIDTH + c, m) for r, c, m in inside)
    return None


def loops_within(excluded, nodata, taken, plume, seed, limits):
    h, w = plume.shape
    n = int((plume > 0).sum())
    if (~excluded).sum() <= h * w:
        return None
    for limit in limits:
        for key, place in sorted((key_of(seed, p), p) for p in range(excluded.size)):
            row, col = divmod(place, WIDTH)
            if row + h > HEIGHT or col + w > WIDTH:
                continue
            box = [(r, c) for r in range(row, row + h) for c in range(col, col + w)]
            if not any(taken[p] for p in box) and max(sum(excluded[p] for p in box), sum(nodata[p] for p in box)) <= limit * n:
                return row, col, bool(key % 2), limit
    return None


def case():
    rng = np.random.default_rng(5)
    library = {}
    for i, (h, w) in enumerate([(2, 3), (4, 2), (1, 1), (3, 5), (12, 2)]):
        values = rng.integers(0, 9, (h, w)).astype(float)
        values[0, 0] = values[-1, -1] = 3
        library[i] = values
    chips = [(i, rng.random((HEIGHT, WIDTH)) < share, rng.random((HEIGHT, WIDTH)) < share / 3) for i, share in enumerate([0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.95, 1.0])]
    wanted = [(i, k, int(rng.integers(0, 5)), int(rng.integers(0, 2**40))) for i, *_ in chips for k in range(4)]
    return library, chips, wanted


@pytest.fixture(scope="module")
def given(spark):
    library, chips, wanted = case()
    rows = spark.createDataFrame([(i, b.ravel().tolist(), n.ravel().tolist()) for i, b, n in chips], KEYS)
    plumes = spark.createDataFrame([(i, *v.shape, v.ravel().tolist()) for i, v in library.items()], LIBRARY)
    return PL.with_plumes(rows, spark.createDataFrame(wanted, "chip int, order int, plume_id long, seed long"), plumes, ["chip"])


def test_by_source(given):
    library, chips, wanted = case()
    found = {(r["chip"], p["order"]): p for r in PL.place_by_source(given, F.col("blocked"), F.col("nodata"), WIDTH).collect() for p in r["placed"]}
    expected = {}
    for i, blocked, nodata in chips:
        for _, order, plume, seed in [w for w in wanted if w[0] == i]:
            place = loops_by_source(~(blocked | nodata), library[plume], seed)
            if place:
                expected[i, order] = place
    assert {k: (p["row"], p["col"], p["flipped"], sorted(zip(p["at"], p["mass"], strict=True))) for k, p in found.items()} == expected
    assert 8 < len(expected) < len(wanted) and all(p["share"] >= 0.8 for p in found.values())


@pytest.mark.parametrize("limits", [PL.GROWING_LIMITS, (0.0,)])
def test_within_limits(given, limits):
    library, chips, wanted = case()
    found = {(r["chip"], p["order"]): p for r in PL.place_within_limits(given, F.col("blocked"), F.col("nodata"), WIDTH, limits).collect() for p in r["placed"]}
    expected = {}
    for i, blocked, nodata in chips:
        taken = np.zeros(blocked.shape, bool)
        for _, order, plume, seed in sorted(w for w in wanted if w[0] == i):
            place = loops_within(blocked, nodata, taken, library[plume], seed, limits)
            if place:
                expected[i, order] = place
                row, col, flipped, _ = place
                side = library[plume][:, ::-1] if flipped else library[plume]
                for r, c in zip(*np.nonzero(side), strict=True):
                    taken[row + r, col + c] = True
    assert {k: (p["row"], p["col"], p["flipped"], p["allowed"]) for k, p in found.items()} == expected
    assert 4 < len(expected) < len(wanted)
    if len(limits) > 1:
        assert len({limit for *_, limit in expected.values()}) > 2


def test_awkward_chips_and_plumes(spark):
    """Null, empty and unknown ones: wanted, never placed; padding is trimmed; nulls in a mask are set; other columns stay."""
    library = spark.createDataFrame([(1, 3, 3, [0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, float("nan")]), (2, 2, 2, [1.0]), (3, None, 2, [1.0, 1.0]), (4, 1, 2, None), (5, 1, 2, [None, 2.0]), (6, 1, 1, [0.0]), (7, 2, 2, [1.0] * 4)], LIBRARY)
    clear, shut = [False] * 4, [True] * 4
    chips = spark.createDataFrame([(0, clear, clear, "a"), (1, shut, clear, "b"), (2, None, clear, "c"), (3, [], [], "d"), (4, [None, None, False, None], clear, "e"), (None, clear, clear, "f"), (6, clear, clear, "g")], f"{KEYS}, values string")
    wanted = spark.createDataFrame([(c, k, k, 7) for c in (0, 1, 2, 3, 4) for k in range(1, 9)] + [(0, 9, 1, None), (6, 1, None, 1), (99, 1, 1, 1)], "chip int, order int, plume_id long, seed long")
    given = PL.with_plumes(chips, wanted, library, ["chip"])
    assert given.columns == [*chips.columns, "plumes"]
    source = {r["values"]: r for r in PL.plume_summary(PL.place_by_source(given, F.col("blocked"), F.col("nodata"), 2), F.array(F.lit(-0.5), F.lit(0.0), F.lit(None))).collect()}
    assert [(source[c]["wanted"], source[c]["inserted"]) for c in "abcdefg"] == [(9, 4), (8, 0), (8, 0), (8, 0), (8, 2), (0, 0), (0, 0)]
    assert [p["order"] for p in source["a"]["placed"]] == [1, 5, 7, 9] and source["a"]["plume_sizes"] == [1, 1, 4, 1]
    assert [(p["order"], p["row"], p["col"]) for p in source["e"]["placed"]] == [(1, 1, 0), (5, 1, 0)]
    assert (source["a"]["min_frac"], source["a"]["frac_abs_sum"], source["a"]["size"]) == (-0.5, 0.5, 1)
    within = {r["values"]: r["placed"] for r in PL.place_within_limits(given, F.col("blocked"), F.col("nodata"), 2).collect()}
    assert [p["order"] for p in within["a"]] == [1, 5, 9] and len({(p["row"], p["col"]) for p in within["a"]}) == 3
    assert not any(within[c] for c in "bcdefg")
    assert PL.place_by_source(given.limit(0), F.col("blocked"), F.col("nodata"), 2).count() == 0


def test_a_large_raster_needs_no_pairs():
    """A raster of 1,024 x 1,024 pixels whose only good place is a small hole; a plume of 40 x 30."""
    blocked = np.ones((1024, 1024), bool)
    blocked[700:760, 300:350] = False
    plume = np.ones((40, 30))
    row, col, _, share, limit = PL.first_fitting(blocked, np.zeros_like(blocked), np.zeros_like(blocked), plume, 12345, (0.0,))
    assert 700 <= row <= 720 and 300 <= col <= 320 and (share, limit) == (0.0, 0.0)
    row, col, _, share = PL.first_visible(~blocked, plume, 12345, 0.8)
    assert share >= 0.8 and not blocked[row, col]


def test_plumes_are_placed_once_and_in_slices(spark, monkeypatch):
    """An explode's filter doesn't run the placing again, and slices of any size give the same."""
    one = "array<struct<order: int, plume_id: long, height: int, width: int, seed: long, values: array<double>>>"
    chips = spark.createDataFrame([(1, [False] * 4, [False] * 4, [])], f"{KEYS}, plumes {one}")
    pixels = PL.placed_pixels(PL.place_by_source(chips, F.col("blocked"), F.col("nodata"), 2), ["chip"], 2)
    assert pixels._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    rng = np.random.default_rng(6)
    masks = pa.array([*(rng.random((7, 6)) < 0.2).tolist(), [], None])
    lists = lambda *x: pa.array([list(x)] * 9)
    columns = (masks, masks, lists(1, 2), lists(7, 8), lists(1, 2), lists(2, 1), pa.array([[1.0, 2.0, 3.0, 4.0]] * 9), lists(5, 6))
    monkeypatch.setattr(PL, "_SLICE", 1 << 20)
    whole = PL._placing(PL._within_limits, 3, (0.3, 1.0)).func(*columns)
    for pixels_ in (1, 13):
        monkeypatch.setattr(PL, "_SLICE", pixels_)
        assert PL._placing(PL._within_limits, 3, (0.3, 1.0)).func(*columns).equals(whole)
    assert len(whole) == 9 and max(map(len, whole.to_pylist())) == 2
