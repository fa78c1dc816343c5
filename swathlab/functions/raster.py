"""Raster arrays kept in one row: band-major, flat index b * H * W + r * W + c."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(raster: Column | str, b: Column | int, pixels: int) -> Column:
    """One band, ``b`` from 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.slice(_c(raster), b * pixels + 1, F.lit(pixels))


def select_bands(raster: Column | str, bands: Column | str, wanted: list[str], pixels: int) -> Column:
    """The wanted bands in that order; null if one isn't there."""
    places = F.array(*[F.array_position(_c(bands), F.lit(w)).cast("int") for w in wanted])
    picked = F.flatten(F.transform(places, lambda p: F.slice(_c(raster), (F.greatest(p, F.lit(1)) - 1) * pixels + 1, F.lit(pixels))))
    return F.when(~F.exists(places, lambda p: p == 0), picked)


def concat_snapshots(*rasters: Column | str) -> Column:
    return F.concat(*[_c(r) for r in rasters])


def flip_horizontal(raster: Column | str, size: int) -> Column:
    """Columns mirrored in each row of each band."""
    return F.transform(_c(raster), lambda _, i: F.element_at(_c(raster), (i - i % size + (size - 1 - i % size) + 1).cast("int")))


def rotate90(raster: Column | str, size: int) -> Column:
    """A square raster of one band turned counter-clockwise: out[r][c] = in[c][size - 1 - r]."""
    return F.transform(_c(raster), lambda _, i: F.element_at(_c(raster), ((i % size) * size + (size - 1 - F.floor(i / size)) + 1).cast("int")))


def crop(raster: Column | str, size: int, r0: int, c0: int, height: int, width: int) -> Column:
    rows = [F.slice(_c(raster), (r0 + r) * size + c0 + 1, width) for r in range(height)]
    return F.concat(*rows)


def pad(raster: Column | str, height: int, width: int, size: int, fill: float = 0.0) -> Column:
    """To size x size, filled at the right and the bottom."""
    rows = [F.concat(F.slice(_c(raster), r * width + 1, width), F.array_repeat(F.lit(fill), size - width)) for r in range(height)]
    return F.concat(*rows, F.array_repeat(F.lit(fill), size * (size - height)))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(raster: Column | str, size: int, reach: int, largest: bool = True) -> Column:
    """The largest (or least) value of the square of 2 * reach + 1 pixels a side around each pixel, cut at the edges.

    Separable: along rows, then along columns, so a pixel costs two spans, not a square. Nulls don't count. One band, any height.
    """
    of = F.array_max if largest else F.array_min

    def along_row(values: Column, i: Column) -> Column:
        left = F.greatest(i % size - reach, F.lit(0))
        right = F.least(i % size + reach, F.lit(size - 1))
        return of(F.slice(values, (i - i % size + left + 1).cast("int"), (right - left + 1).cast("int")))

    def along_column(values: Column, i: Column) -> Column:
        row = F.floor(i / size)
        rows = F.sequence(F.greatest(row - reach, F.lit(0).cast("long")), F.least(row + reach, F.floor(F.size(values) / size) - 1))
        return of(F.transform(rows, lambda r: F.get(values, (r * size + i % size).cast("int"))))

    rows = _held(_c(raster), lambda values: F.transform(values, lambda _, i: along_row(values, i)))
    return _held(rows, lambda values: F.transform(values, lambda _, i: along_column(values, i)))


def dilate(mask: Column | str, size: int, reach: int = 1) -> Column:
    """An array of booleans widened by a square, within the raster. Nulls aren't set."""
    return running(F.transform(_c(mask), lambda m: F.coalesce(m, F.lit(False))), size, reach)


def erode(mask: Column | str, size: int, reach: int = 1) -> Column:
    """Whether all pixels of the square are set; beyond the raster nothing is."""
    least = running(F.transform(_c(mask), lambda m: F.coalesce(m, F.lit(False))), size, reach, largest=False)
    return _held(least, lambda values: F.transform(values, lambda m, i: m & (i % size).between(reach, size - 1 - reach) & F.floor(i / size).between(F.lit(reach), F.floor(F.size(values) / size) - 1 - reach)))


def keep_signal(raster: Column | str, width: int, least: float) -> Column:
    """height, width and values (row by row) of the rows and columns that have a value above ``least``; those without are dropped,
    inner ones too. Null and NaN are no signal. A raster without signal has neither rows nor columns."""

    def signal(x: Column) -> Column:
        return F.coalesce((x > least) & ~F.isnan(x.cast("double")), F.lit(False))

    def cut(values: Column) -> Column:
        places = F.sequence(F.lit(0).cast("long"), F.size(values).cast("long") - 1)
        at = F.filter(places, lambda i: signal(F.get(values, i.cast("int"))))
        rows, cols = F.array_sort(F.array_distinct(F.transform(at, lambda i: F.floor(i / width)))), F.array_sort(F.array_distinct(F.transform(at, lambda i: i % width)))
        return _held(F.struct(rows.alias("r"), cols.alias("c")), lambda k: F.struct(
            F.size(k["r"]).alias("height"), F.size(k["c"]).alias("width"), F.flatten(F.transform(k["r"], lambda r: F.transform(k["c"], lambda c: F.get(values, (r * width + c).cast("int"))))).alias("values"),
        ))

    return F.when(F.size(_c(raster)) > 0, _held(_c(raster), cut))


def set_pixels(mask: Column | str, size: int) -> Column:
    """Places (structs of row and col) of the set pixels of an array of booleans."""
    places = F.transform(_c(mask), lambda m, i: F.when(m, F.struct(F.floor(i / size).cast("int").alias("row"), (i % size).cast("int").alias("col"))))
    return F.array_compact(places)


def clean_plume(raster: Column | str, factor: float) -> Column:
    """NaN and null as 0, at least 0, times a factor."""
    return F.transform(_c(raster), lambda x: F.greatest(F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)), F.lit(0.0)) * factor)


def scaled(raster: Column | str, factor: float) -> Column:
    return F.transform(_c(raster), lambda x: x * factor)


def first_or_zero(values: Column | str) -> Column:
    """The only item of a list, 0 for none; more than one is an error."""
    n = F.coalesce(F.size(_c(values)), F.lit(0))
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.get(_c(values), 0)).otherwise(F.raise_error(F.lit("more than one item")).cast("double"))


def has_signal(raster: Column | str) -> Column:
    return F.exists(_c(raster), lambda x: x != 0)
