"""Plumes placed on chips. A chip's row holds its masks and its plumes, so every place of the raster is tested there, without pairs of
places and pixels: box counts come from summed-area tables (four lookups a place), visible masses from blocks of places.

Places are tried in the order of a key that a seed gives, (seed + 48271 * (place + 1)) ** 2 modulo 2 ** 31 - 1, ties by place (row by row);
an odd key mirrors the plume. All places are tried, so a plume stays out only if none suits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of a plume that may lie on a mask, tried in turn, and the share of its mass that must be seen.
GROWING_LIMITS = (0.075, 0.125, 0.185, 0.255, 0.335)
VISIBLE = 0.8

_PRIME, _STEP = 2**31 - 1, 48271
#: Places whose visible mass is computed at once.
_BLOCK = 64
#: Pixels of the chips whose plumes are placed at once.
_SLICE = 1 << 16
_PLACED = "array<struct<order: int, plume_id: long, row: int, col: int, flipped: boolean, share: double, allowed: double, at: array<int>, mass: array<double>>>"
_ARROW_PLACED = pa.list_(pa.struct([("order", pa.int32()), ("plume_id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("flipped", pa.bool_()), ("share", pa.float64()),
                                    ("allowed", pa.float64()), ("at", pa.list_(pa.int32())), ("mass", pa.list_(pa.float64()))]))


def place_keys(seed: int, places: int) -> np.ndarray:
    x = (seed % _PRIME + _STEP * np.arange(1, places + 1, dtype=np.int64)) % _PRIME
    return x * x % _PRIME


def trimmed(plume: np.ndarray) -> np.ndarray:
    """Without the rows and columns of zeros around it; NaN, infinite and negative values are zeros."""
    plume = np.where(np.isfinite(plume) & (plume > 0), plume, 0.0)
    rows, cols = np.flatnonzero(plume.any(axis=1)), np.flatnonzero(plume.any(axis=0))
    return plume[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else plume[:0, :0]


def box_counts(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Set pixels of each box of that size, by its upper left corner."""
    sums = np.pad(mask.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return sums[height:, width:] - sums[:-height, width:] - sums[height:, :-width] + sums[:-height, :-width]


def first_visible(clear: np.ndarray, plume: np.ndarray, seed: int, visible: float) -> tuple[int, int, bool, float] | None:
    """The first clear place of the plume's source (its largest pixel) that shows enough of its mass: row, col, mirrored, share."""
    if not plume.size:
        return None
    height, width = clear.shape
    key = place_keys(seed, clear.size)
    order = np.argsort(key, kind="stable")
    order = order[clear.ravel()[order]]
    total = plume.sum()
    sides = []
    for side in (plume, plume[:, ::-1]):
        r, c = np.nonzero(side)
        top = np.unravel_index(side.argmax(), side.shape)
        sides.append((r - top[0], c - top[1], side[r, c]))
    for start in range(0, len(order), _BLOCK):
        block = order[start : start + _BLOCK]
        share = np.zeros(len(block))
        for flipped, (dr, dc, mass) in enumerate(sides):
            which = np.flatnonzero(key[block] % 2 == flipped)
            r, c = block[which, None] // width + dr, block[which, None] % width + dc
            inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
            seen = inside & clear[np.clip(r, 0, height - 1), np.clip(c, 0, width - 1)]
            share[which] = (seen * mass).sum(axis=1) / total
        good = np.flatnonzero(share >= visible)
        if len(good):
            at = int(block[good[0]])
            return at // width, at % width, bool(key[at] % 2), float(share[good[0]])
    return None


def first_fitting(excluded: np.ndarray, nodata: np.ndarray, taken: np.ndarray, plume: np.ndarray, seed: int, limits: tuple[float, ...]) -> tuple[int, int, bool, float, float] | None:
    """The first place of the least limit where the plume's box lies in the raster, free of others, with no more excluded pixels, nor
    pixels without data, than the limit's share of the plume's own: row, col of its corner, mirrored, share, limit."""
    (height, width), (h, w) = excluded.shape, plume.shape
    n = int((plume > 0).sum())
    if not n or h > height or w > width or (~excluded).sum() <= h * w:
        return None
    worst = np.maximum(box_counts(excluded, h, w), box_counts(nodata, h, w))
    level = np.searchsorted(np.array(limits) * n, worst, side="left")
    rows, cols = np.nonzero((level < len(limits)) & (box_counts(taken, h, w) == 0))
    if not len(rows):
        return None
    key = place_keys(seed, excluded.size)[rows * width + cols]
    best = np.lexsort((key, level[rows, cols]))[0]
    r, c = int(rows[best]), int(cols[best])
    return r, c, bool(key[best] % 2), float(worst[r, c] / n), float(limits[level[r, c]])


def _by_source(blocked: np.ndarray, nodata: np.ndarray, plumes: list, visible: float) -> list[dict]:
    clear, out = ~(blocked | nodata), []
    for order, plume_id, plume, seed in plumes:
        found = first_visible(clear, plume, seed, visible)
        if found:
            row, col, flipped, share = found
            side = plume[:, ::-1] if flipped else plume
            top = np.unravel_index(side.argmax(), side.shape)
            out.append(_record(order, plume_id, row, col, flipped, share, visible, side, row - top[0], col - top[1], clear.shape))
    return out


def _within_limits(blocked: np.ndarray, nodata: np.ndarray, plumes: list, limits: tuple[float, ...]) -> list[dict]:
    taken, out = np.zeros(blocked.shape, bool), []
    for order, plume_id, plume, seed in plumes:
        found = first_fitting(blocked, nodata, taken, plume, seed, limits)
        if found:
            row, col, flipped, share, limit = found
            side = plume[:, ::-1] if flipped else plume
            taken[row : row + side.shape[0], col : col + side.shape[1]] |= side > 0
            out.append(_record(order, plume_id, row, col, flipped, share, limit, side, row, col, blocked.shape))
    return out


def _record(order, plume_id, row, col, flipped, share, allowed, side, r0, c0, shape) -> dict:
    r, c = np.nonzero(side)
    mass = side[r, c]
    r, c = r + r0, c + c0
    inside = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
    at = (r * shape[1] + c)[inside]
    names = ("order", "plume_id", "row", "col", "flipped", "share", "allowed", "at", "mass")
    return dict(zip(names, (order, plume_id, row, col, flipped, share, allowed, at.tolist(), mass[inside].tolist()), strict=True))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of arrays; a null one is empty."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def _placing(place: Callable, width: int, parameter: object) -> Callable[..., Column]:
    """The places of a batch's plumes, found in slices of about ``_SLICE`` pixels, so that no more of them than a slice's are Python objects at once."""

    @F.arrow_udf(_PLACED)
    def run(blocked: pa.Array, nodata: pa.Array, orders: pa.Array, ids: pa.Array, heights: pa.Array, widths: pa.Array, values: pa.Array, seeds: pa.Array) -> pa.Array:
        columns = (blocked, nodata, orders, ids, heights, widths, values, seeds)
        step = max(1, _SLICE * len(blocked) // max(1, len(blocked.flatten())))
        parts = [pa.array([], _ARROW_PLACED)]
        for first in range(0, len(blocked), step):
            out = []
            for b, e, *lists, flat, seed in zip(*[_lists(c.slice(first, step)) for c in columns], strict=True):
                plumes, start = [], 0
                for order, plume_id, h, w, s in zip(*lists, seed, strict=True):
                    plumes.append((int(order), int(plume_id), trimmed(np.asarray(flat[start : start + h * w], float).reshape(h, w)), int(s)))
                    start += h * w
                shape = (-1, width)
                out.append(place(np.asarray(b, bool).reshape(shape), np.asarray(e, bool).reshape(shape), plumes, parameter) if len(b) else [])
            parts.append(pa.array(out, _ARROW_PLACED))
        return pa.concat_arrays(parts)

    # nor is it run twice: once for the filter that an explode of it brings, which would be pushed below it, and once for its rows
    return run.asNondeterministic()


def with_plumes(chips: DataFrame, wanted: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """``chips`` with ``plumes``, those wanted of each in their order; an empty list for none.

    ``wanted``: keys, order, plume_id, seed; ``library``: plume_id, height, width, values (row by row), one row a plume. A plume that
    the library doesn't hold, or whose values don't fill height x width, is wanted but never placed. The chip's key and order should tell
    its plumes apart; those that share them are taken by id.
    """
    fits = F.coalesce(F.size("values") == F.col("height") * F.col("width"), F.lit(False))
    known = library.select("plume_id", *[F.when(fits, F.col(c)).otherwise(F.lit(0)).cast("int").alias(c) for c in ("height", "width")],
                           F.when(fits, F.transform("values", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))).otherwise(F.array().cast("array<double>")).alias("values"))
    found = wanted.select(*keys, "order", "plume_id", F.coalesce("seed", F.lit(0)).cast("long").alias("seed")).join(known, "plume_id", "left")
    one = F.struct(
        F.col("order").cast("int").alias("order"), F.col("plume_id").cast("long").alias("plume_id"), F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("width", F.lit(0)).alias("width"), "seed",
        F.coalesce("values", F.array().cast("array<double>")).alias("values"),
    )
    listed = found.where(F.col("plume_id").isNotNull() & F.col("order").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("plumes"))
    none = F.array().cast(listed.schema["plumes"].dataType)
    return chips.join(listed, keys, "left").withColumn("plumes", F.coalesce("plumes", none))


def _placed(chips: DataFrame, blocked: Column, nodata: Column, run: Callable[..., Column]) -> DataFrame:
    flags = [F.coalesce(F.transform(m, lambda x: F.coalesce(x, F.lit(True))), F.array().cast("array<boolean>")) for m in (blocked, nodata)]
    lists = [F.col(f"plumes.{c}") for c in ("order", "plume_id", "height", "width")]
    return chips.withColumn("placed", run(*flags, *lists, F.flatten("plumes.values"), F.col("plumes.seed")))


def place_by_source(chips: DataFrame, blocked: Column, nodata: Column, width: int, visible: float = VISIBLE) -> DataFrame:
    """``chips`` (see ``with_plumes``) with ``placed``: each plume's source on a pixel that is neither blocked nor without data, at the first
    place that shows ``visible`` of its mass on such pixels. What lies beyond the edge is cut; plumes may overlap.

    ``blocked`` and ``nodata``: arrays of booleans row by row, a null in them counts as set; null or empty arrays hold no place. ``placed``:
    order, plume_id, row and col (of the source), flipped, share (of the mass seen), allowed, and the plume's pixels: at (row * width + col), mass.
    """
    return _placed(chips, blocked, nodata, _placing(_by_source, width, visible))


def place_within_limits(chips: DataFrame, blocked: Column, nodata: Column, width: int, limits: tuple[float, ...] = GROWING_LIMITS) -> DataFrame:
    """``chips`` with ``placed``, as ``place_by_source`` has it (row and col: of the box's corner; share: of the plume's pixels): plumes wholly
    in the raster, none over one before it, and no more of their box blocked (or without data) than a share of their pixels.

    A higher limit counts only where no place suits the lower ones; (0.0,) allows nothing. A chip with no more unblocked pixels than the box gets none.
    """
    return _placed(chips, blocked, nodata, _placing(_within_limits, width, tuple(sorted(limits))))


def placed_pixels(placed: DataFrame, keys: list[str], width: int) -> DataFrame:
    """A row for each pixel of a placed plume: keys, plume_id, row, col, mass."""
    each = placed.select(*keys, F.explode("placed").alias("_p")).select(*keys, F.col("_p.plume_id").alias("plume_id"), F.explode(F.arrays_zip("_p.at", "_p.mass")).alias("_x"))
    return each.select(*keys, "plume_id", F.floor(F.col("_x.at") / width).cast("int").alias("row"), (F.col("_x.at") % width).cast("int").alias("col"), F.col("_x.mass").alias("mass"))


#: Fixed value: the least relative change of a pixel that counts as plume.
LEAST_CHANGE = 0.001


def plume_summary(placed: DataFrame, frac: str) -> DataFrame:
    """``placed`` with min_frac, frac_abs_sum and size (pixels of a change above ``LEAST_CHANGE``) of an array of relative changes, and how
    many plumes were wanted and inserted, with the pixels of each inserted one. Null changes don't count."""
    known = F.filter(frac, lambda v: v.isNotNull())
    return placed.withColumns({
        "min_frac": F.array_min(known), "frac_abs_sum": F.aggregate(known, F.lit(0.0), lambda total, v: total + F.abs(v)), "size": F.size(F.filter(known, lambda v: F.abs(v) > LEAST_CHANGE)).cast("long"),
        "wanted": F.size("plumes").cast("long"), "inserted": F.size("placed").cast("long"), "plume_sizes": F.transform("placed", lambda p: F.size(p["at"])),
    })
