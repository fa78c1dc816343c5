"""Plumes: components of a probability raster, their properties, emission rates, insertion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import emission_rate
from .physics import forward_lookup

# Deviations from medians, and the default errors of the wind and the method.
MAD_TO_SIGMA, Z95 = 1.4826, 1.96
METHOD_ERROR, WIND_ERROR = 0.13, 0.32

#: Pixels that are labelled at once.
SLICE = 1 << 16


def hysteresis_labels(probability: np.ndarray, marker: float, floor: float) -> np.ndarray:
    """Labels of rasters (n, H, W): 8-connected pixels at or above the floor that hold one at or above the marker.

    A label is 1 + the flat index of the component's first pixel; 0 is none.
    """
    n, height, width = probability.shape
    mask = probability >= floor
    big = height * width + 1
    labels = np.where(mask, np.arange(1, big).reshape(height, width), big)
    while True:
        padded = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=big)
        least = labels
        for r in range(3):
            for c in range(3):
                least = np.minimum(least, padded[:, r : r + height, c : c + width])
        least = np.where(mask, least, big)
        # jump to the label's own label
        flat = np.concatenate([least.reshape(n, -1), np.full((n, 1), big)], axis=1)
        least = np.minimum(least, np.take_along_axis(flat, (least - 1).reshape(n, -1), axis=1).reshape(least.shape))
        if np.array_equal(least, labels):
            break
        labels = least
    strong = np.zeros((n, big + 1), bool)
    which, at = np.nonzero((probability >= marker).reshape(n, -1))
    strong[which, labels.reshape(n, -1)[which, at]] = True
    keep = np.take_along_axis(strong, labels.reshape(n, -1), axis=1).reshape(labels.shape) & mask
    return np.where(keep, labels, 0)


class ComponentTree:
    """The components of one raster at every floor at once.

    Pixels at or above ``least`` are added in falling order of value; a pixel joins the components of its neighbours
    (8-connected) and becomes their parent, by union-find. A pixel's component at a floor is then the part of the tree below
    its last ancestor that reaches the floor, and that ancestor knows the part's largest value, area and first pixel.
    """

    def __init__(self, raster: np.ndarray, least: float):
        height, width = raster.shape
        flat = raster.ravel()
        inside = np.flatnonzero(flat >= least)
        order = inside[np.argsort(-flat[inside], kind="stable")]
        self.pixels = order  # flat indices, by falling value
        self.values = flat[order]
        n = len(order)
        at = np.full(height * width, -1)
        at[order] = np.arange(n)
        rows, cols = np.divmod(order, width)
        near = np.full((n, 8), -1)
        steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
        for k, (r, c) in enumerate(steps):
            y, x = rows + r, cols + c
            good = (y >= 0) & (y < height) & (x >= 0) & (x < width)
            near[good, k] = at[y[good] * width + x[good]]
        parent, joined = list(range(n)), list(range(n))
        top, area, first = self.values.tolist(), [1] * n, order.tolist()
        for i, others in enumerate(near.tolist()):
            for j in others:
                if 0 <= j < i:
                    while joined[j] != j:
                        joined[j] = joined[joined[j]]
                        j = joined[j]
                    if j != i:
                        parent[j] = joined[j] = i
                        area[i] += area[j]
                        top[i] = max(top[i], top[j])
                        first[i] = min(first[i], first[j])
        self.parent, self.top, self.area, self.first = np.array(parent, np.int64), np.array(top), np.array(area, np.int64), np.array(first, np.int64)

    def nodes(self, floor: float) -> np.ndarray:
        """For each pixel that reaches the floor, in falling order: the node of its component there."""
        n = int(np.searchsorted(-self.values, -floor, side="right"))  # those at or above the floor come first
        node = np.arange(n)
        up = np.where(self.parent[:n] < n, self.parent[:n], node)
        while not np.array_equal(up, node):
            node, up = up, up[up]
        return node

    def component_pixels(self, marker: float, floor: float) -> np.ndarray:
        """Flat indices of the pixels of components at the floor that reach the marker."""
        node = self.nodes(floor)
        return self.pixels[: len(node)][self.top[node] >= marker]

    def component_area(self, marker: float, floor: float) -> int:
        """Their number."""
        node = np.unique(self.nodes(floor))
        return int(self.area[node][self.top[node] >= marker].sum())


def _rasters(lists: pa.Array, size: int) -> Iterator[np.ndarray | None]:
    """The rasters of a column of arrays, NaN and null pixels as -inf; None for a null one."""
    for x in lists:
        yield None if not x.is_valid else np.nan_to_num(np.array(x.values.to_numpy(zero_copy_only=False), np.float64), nan=-np.inf, posinf=np.inf, neginf=-np.inf).reshape(size, size)


def slices(batches: Iterator[pa.RecordBatch], pixels: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows (of so many pixels each) that have ``SLICE`` pixels at most, or one row."""
    step = max(1, SLICE // pixels)
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def component_areas(chips: DataFrame, keep: tuple[str, ...], raster: str, size: int, pairs: list[tuple[float, float]]) -> DataFrame:
    """One row per chip: the ``keep`` columns and areas, the number of pixels in components for each (marker, floor).

    A chip's tree is built once for all pairs. A null raster has no components.
    """
    least = min((floor for _, floor in pairs), default=np.inf)
    schema = T.StructType([*(chips.schema[k] for k in keep), T.StructField("areas", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = []
            for values in _rasters(batch.column(0), size):
                tree = None if values is None else ComponentTree(values, least)
                areas.append([0 if tree is None else tree.component_area(m, f) for m, f in pairs])
            yield pa.RecordBatch.from_arrays([*(batch.column(1 + i) for i in range(len(keep))), pa.array(areas, pa.list_(pa.int64()))], names=schema.names)

    return chips.select(F.col(raster).cast("array<double>").alias("_raster"), *keep).mapInArrow(run, schema)


def component_hits(chips: DataFrame, keep: tuple[str, ...], raster: str, plume: str, plumes: int, size: int, pairs: list[tuple[float, float]]) -> DataFrame:
    """One row per chip and plume: the ``keep`` columns, plume, n (its pixels), hits (for each (marker, floor), how many of them lie in
    components; none if the plume's own pixels don't reach the marker).

    ``plume``: an array like the raster with each pixel's plume, from 0 to ``plumes`` - 1, null where there is none. Every
    plume has a row for every chip, also without pixels. Components are those of the whole raster, built once for all pairs.
    """
    least = min((floor for _, floor in pairs), default=np.inf)
    schema = T.StructType([*(chips.schema[k] for k in keep), T.StructField("plume", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, hits = [], []
            for values, marks in zip(_rasters(batch.column(0), size), batch.column(1), strict=True):
                which = np.full(size * size, -1, np.int64)
                if marks.is_valid:
                    which = marks.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                real = which >= 0
                ns.append(np.bincount(which[real], minlength=plumes))
                found = np.zeros((plumes, len(pairs)), np.int64)
                if values is not None and real.any():
                    tree, own = ComponentTree(values, least), np.full(plumes, -np.inf)
                    np.maximum.at(own, which[real], values.ravel()[real])
                    for k, (marker, floor) in enumerate(pairs):
                        inside = which[tree.component_pixels(marker, floor)]
                        found[:, k] = np.where(own >= marker, np.bincount(inside[inside >= 0], minlength=plumes), 0)
                hits.append(found)
            rows = np.repeat(np.arange(batch.num_rows), plumes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(2 + i).take(pa.array(rows)) for i in range(len(keep))), pa.array(np.tile(np.arange(plumes), batch.num_rows), pa.int32()), pa.array(np.concatenate([*ns, np.zeros(0, np.int64)]).astype(np.int64)), pa.array([r.tolist() for h in hits for r in h], pa.list_(pa.int64()))],
                names=schema.names,
            )

    return chips.select(F.col(raster).cast("array<double>").alias("_raster"), F.col(plume).cast("array<int>").alias("_plume"), *keep).mapInArrow(run, schema)


def label_chips(chips: DataFrame, chip: str, raster: str, size: int, marker: float, floor: float, values: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel of a component: chip, row, col, label, the pixel's ``values`` (columns of arrays like the raster) and
    the chip's ``keep`` columns. ``raster``: probabilities of one band, row-major.

    A chip is labelled within its row, and takes its values along, so nothing is exchanged or joined and work grows with the chips;
    a batch is labelled in slices, so memory doesn't grow with it.
    Null rasters have no components; null and NaN pixels are in none; null arrays have null values.
    """
    fields = {f.name: f.dataType for f in chips.schema}
    schema = T.StructType(
        [T.StructField(chip, fields[chip]), *(T.StructField(n, T.IntegerType()) for n in ("row", "col", "label"))]
        + [T.StructField(v, fields[v].elementType) for v in values] + [T.StructField(k, fields[k]) for k in keep]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size * size):
            batch = batch.filter(batch.column(1).is_valid())
            pixels = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size, size)
            labels = hysteresis_labels(np.nan_to_num(pixels, nan=-np.inf), marker, floor)
            which, row, col = np.nonzero(labels)
            columns = [batch.column(0).take(pa.array(which)), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(labels[which, row, col], pa.int32())]
            for i in range(len(values)):
                lists = batch.column(2 + i)
                places = np.asarray(lists.offsets)[which] + row * size + col
                columns.append(lists.values.take(pa.array(places, pa.int64(), mask=lists.is_null().to_numpy(zero_copy_only=False)[which])))
            columns += [batch.column(2 + len(values) + i).take(pa.array(which)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chips.select(chip, F.col(raster).cast("array<double>").alias("_raster"), *values, *[F.col(k) for k in keep]).mapInArrow(run, schema)


def properties(labelled: DataFrame, keys: list[str], value: str) -> DataFrame:
    """area, half-open box, max, mean and population deviation of each component."""
    return labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"),
        F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )


def central_plume(labelled: DataFrame, keys: list[str], size: int, radius: float) -> DataFrame:
    """The label of the pixel nearest the centre, within the radius; chips without one are left out."""
    centre = (size - 1) / 2
    d2 = F.pow(F.col("row") - centre, 2) + F.pow(F.col("col") - centre, 2)
    near = labelled.withColumn("_d", d2).where(F.col("_d") <= radius * radius)
    return near.groupBy(*keys).agg(F.min(F.struct("_d", "row", "col", "label")).alias("_n")).select(*keys, F.col("_n.label").alias("label"))


def source_location(labelled: DataFrame, keys: list[str], value: str, x0: float, y0: float, pixel: float) -> DataFrame:
    """Map coordinates of the centre of each component's largest pixel (the first in scan order on ties)."""
    best = F.max_by(F.struct("row", "col"), F.struct(value, -F.col("row"), -F.col("col"))).alias("_p")
    found = labelled.groupBy(*keys, "label").agg(best)
    return found.select(*keys, "label", (x0 + (F.col("_p.col") + 0.5) * pixel).alias("x"), (y0 - (F.col("_p.row") + 0.5) * pixel).alias("y"))


def area_length_ime(labelled: DataFrame, keys: list[str], value: str, pixel: float) -> DataFrame:
    """area (m2), length (its root) and integrated mass over positive pixels."""
    positive = F.col(value) > 0
    area = F.count_if(positive) * (pixel * pixel)
    return labelled.groupBy(*keys).agg(area.alias("area"), F.sqrt(area).alias("length"), (F.coalesce(F.sum(F.when(positive, F.col(value))), F.lit(0.0)) * (pixel * pixel)).alias("ime"))


def plume_features(labelled: DataFrame, keys: list[str], value: str, probability: str, pixel: float, x0: float, y0: float) -> DataFrame:
    """Of each component, by one aggregate: area, half-open box, likelihood (ten times the largest probability), map coordinates of its
    most probable pixel, and length and ime of its positive pixels."""
    positive = F.col(value) > 0
    best = F.max_by(F.struct("row", "col"), F.struct(probability, -F.col("row"), -F.col("col"))).alias("_p")
    found = labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"), (F.max(probability) * 10).alias("likelihood"), best,
        F.sqrt(F.count_if(positive) * (pixel * pixel)).alias("length"), (F.coalesce(F.sum(F.when(positive, F.col(value))), F.lit(0.0)) * (pixel * pixel)).alias("ime"),
    )
    return found.withColumns({"x": x0 + (F.col("_p.col") + 0.5) * pixel, "y": y0 - (F.col("_p.row") + 0.5) * pixel}).drop("_p")


def all_methods(labelled: DataFrame, keys: list[str], kinds: dict[str, Column], masks: dict[str, Column], winds: dict[str, float], size: int, pixel: float, least: float, most: float) -> DataFrame:
    """Emission rates: keys, mask, kind (of retrieval), method, source (of the wind), rate.

    ``kinds``: values of a pixel; ``masks``: which pixels count; methods: root_area, major_axis and circle_distance (within
    ``least`` to ``most`` pixels). Rates are computed once for a wind of 1 and scaled.
    """
    listed = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in masks.items()]))
    masked = labelled.withColumns({f"_{k}": v for k, v in kinds.items()}).withColumn("mask", F.explode(listed))
    valued = masked.select(*keys, "mask", "row", "col", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("value")) for k in kinds])).alias("_k")).select(*keys, "mask", "row", "col", "_k.*")
    group = [*keys, "mask", "kind"]
    masses = area_length_ime(valued, group, "value", pixel)
    axes = major_axis(masked, [*keys, "mask"]).withColumnRenamed("length", "_axis")
    circles = circle_distance_rate(valued, group, "value", size, pixel, 1.0, least, most).withColumnRenamed("rate", "circle_distance")
    joined = masses.join(axes, [*keys, "mask"]).join(circles, group)
    joined = joined.withColumns({"root_area": emission_rate(F.lit(1.0), "length", "ime"), "major_axis": emission_rate(F.lit(1.0), F.col("_axis") * pixel, "ime")})
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("source"), (F.col(m) * w).alias("rate")) for m in ("root_area", "major_axis", "circle_distance") for s, w in winds.items()])
    return joined.select(*group, F.explode(methods).alias("_m")).select(*group, "_m.*")


def root_area_rate(labelled: DataFrame, keys: list[str], value: str, pixel: float, wind: Column | float) -> DataFrame:
    found = area_length_ime(labelled, keys, value, pixel)
    return found.withColumn("rate", emission_rate(F.lit(wind) if isinstance(wind, float) else wind, "length", "ime"))


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of integer points (n, 2), counter-clockwise, by a monotone chain."""
    order = sorted(set(map(tuple, points.tolist())))

    def half(chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in chain:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(half(order) + half(order[::-1]) or order, np.int64)


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(longer, shorter) side of the least-area rectangle around points, which has a side on an edge of their hull.

    Of rectangles of equal area (to six digits) the one with the least longer side.
    """
    corners = hull(points)
    edges = np.roll(corners, -1, axis=0) - corners
    along, across = corners @ edges.T, corners @ np.stack([-edges[:, 1], edges[:, 0]])
    a, b, square = np.ptp(along, axis=0), np.ptp(across, axis=0), (edges**2).sum(axis=1)
    sides = np.sort(np.stack([a, b]) / np.sqrt(square), axis=0)
    area, longer = np.round(a * b / square, 6), np.round(sides[1], 9)
    best = np.lexsort((longer, area))[0]
    return float(sides[1, best]), float(sides[0, best])


def major_axis(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The longer side, in pixels, of the least-area rectangle around each component: keys, length.

    Only the ends of each row of a component can be corners of its hull, so a component brings two numbers a row, as many
    rows as its raster has at most; its hull and rectangle are found in its row.
    """

    @F.pandas_udf("double")
    def longer(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for r, a, b in zip(rows, first, last, strict=True):
            y, x = np.concatenate([r, r, r + 1, r + 1]), np.concatenate([a, b, a, b])
            out.append(least_rectangle(np.stack([x, y], axis=1).astype(np.int64))[0])
        return pd.Series(out, dtype="float64")

    ends = labelled.groupBy(*keys, "row").agg(F.min("col").alias("_a"), (F.max("col") + 1).alias("_b"))
    listed = ends.groupBy(*keys).agg(F.collect_list(F.struct(F.col("row").alias("r"), F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_e"))
    return listed.select(*keys, longer("_e.r", "_e.a", "_e.b").alias("length"))


def circle_distance_rate(labelled: DataFrame, keys: list[str], value: str, size: int, pixel: float, wind: float, least: float, most: float) -> DataFrame:
    """The largest rate of the mass within a distance of the centre, for distances in [least, most] pixels; null if there is no pixel there."""
    centre = (size - 1) / 2
    d = F.sqrt(F.pow(F.col("row") - centre, 2) + F.pow(F.col("col") - centre, 2))
    order = Window.partitionBy(*keys).orderBy("_d", "row", "col").rowsBetween(Window.unboundedPreceding, 0)
    mass = labelled.withColumn("_d", d).withColumn("_m", F.sum(F.greatest(F.col(value), F.lit(0.0)) * (pixel * pixel)).over(order))
    inside = F.col("_d").between(least, most)
    return mass.groupBy(*keys).agg(F.max(F.when(inside, emission_rate(F.lit(wind), F.col("_d") * pixel, "_m"))).alias("rate"))


def rescaled_retrieval(labelled: DataFrame, keys: list[str], conditional: str, probability: str) -> DataFrame:
    """conditional * probability / the component's largest probability."""
    top = F.max(probability).over(Window.partitionBy(*keys, "label"))
    return labelled.withColumn("rescaled", F.col(conditional) * F.col(probability) / top)


def interval(rows: DataFrame, keys: list[str], q: str, central: Column) -> DataFrame:
    """central, low and high of each group: the 95 % interval in log space of the method's, the wind's and the ensemble's error.

    The ensemble's error is the median absolute deviation of the logarithms of all members and the central value.
    """
    logs = rows.where(F.col(q) > 0).select(*keys, F.ln(q).alias("_l"))
    middle = rows.where(F.col(q) > 0).groupBy(*keys).agg(central.alias("central"))
    every = logs.unionByName(middle.select(*keys, F.ln("central").alias("_l")))
    medians = every.groupBy(*keys).agg(F.median("_l").alias("_m"))
    spread = every.join(medians, keys).groupBy(*keys).agg(F.median(F.abs(F.col("_l") - F.col("_m"))).alias("_mad"))
    sigma = MAD_TO_SIGMA * F.sqrt(F.pow("_mad", 2) + METHOD_ERROR**2 + WIND_ERROR**2)
    found = middle.join(spread, keys)
    return found.select(*keys, "central", (F.col("central") * F.exp(-Z95 * sigma)).alias("low"), (F.col("central") * F.exp(Z95 * sigma)).alias("high"))


def insert_enhancement(rows: DataFrame, table: DataFrame, enhancement: Column, most: float, n: int, band: str) -> DataFrame:
    """``rows`` with ``inserted``, the band attenuated by the lookup table's nb at the enhancement (whole, half to even), and ``frac``, its relative change.

    ``table``: i (from 0 to n, for enhancements from 0 to ``most``), nb. Pixels without signal are left out.
    """
    found = forward_lookup(rows.where(F.col(band) > 0), table, enhancement, most, n, "nb")
    return found.withColumn("inserted", F.rint(F.col(band) * F.col("nb"))).withColumn("frac", F.try_divide(F.col("inserted") - F.col(band), F.col(band))).drop("nb")


def overlay(placed: DataFrame, keys: list[str]) -> DataFrame:
    """All plumes of a chip on one raster: summed mass and the plumes at each pixel."""
    return placed.groupBy(*keys, "row", "col").agg(F.sum("mass").alias("mass"), F.sort_array(F.collect_set("plume_id")).alias("plumes"))
