"""Selection: filters, references of a scene, top-k, set operations, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import days_apart


def in_cloud_range(scenes: DataFrame, low: float, high: float, cloud: str = "cloud_pct") -> DataFrame:
    """low <= cloud < high, shares of 1 against percentages."""
    return scenes.where((F.col(cloud) >= low * 100) & (F.col(cloud) < high * 100))


def search(scenes: DataFrame, tile: object, start: str, end: str, tile_col: str = "tile", time: str = "acquired") -> DataFrame:
    """Scenes of a tile from ``start`` to ``end``, both included."""
    return scenes.where((F.col(tile_col) == tile) & F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def by_mask_shares(pixels: DataFrame, keys: list[str], nodata: Column, bad: Column, nodata_limit: float, bad_limit: float) -> DataFrame:
    """Groups whose share without data, and whose share of bad among valid pixels (1 if none is valid), are below the limits."""
    shares = pixels.groupBy(*keys).agg(F.count_if(nodata).alias("_none"), F.count("*").alias("n"), F.count_if(~nodata & bad).alias("_bad"))
    valid = F.col("n") - F.col("_none")
    shares = shares.select(*keys, (F.col("_none") / F.col("n")).alias("nodata_share"), F.coalesce(F.try_divide("_bad", valid), F.lit(1.0)).alias("bad_share"))
    return shares.where((F.col("nodata_share") < nodata_limit) & (F.col("bad_share") < bad_limit))


def without_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't listed; a null key never is."""
    return rows.join(listed.select(*keys).distinct(), keys, "left_anti")


def only_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed.select(*keys), keys, "left_semi")


def near_in_time(rows: DataFrame, time: str, at: Column, days: int, before_only: bool = False) -> DataFrame:
    """At least one whole day and at most ``days`` away from ``at`` (before it, if asked)."""
    away = days_apart(F.col(time), at)
    return rows.where(away.between(1, days) if before_only else F.floor(F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86400e6).between(1, days))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each check (null counts as broken)."""
    return rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])


def touches_centre(r0: Column, c0: Column, r1: Column, c1: Column, size: int, buffer: int = 3) -> Column:
    """A half-open box meets the centre point widened by the buffer."""
    low, high = size // 2 - buffer, size // 2 + buffer
    return (r0 <= high) & (r1 >= low) & (c0 <= high) & (c1 >= low)


def overlaps_centre(r0: Column, c0: Column, r1: Column, c1: Column, size: int, buffer: int = 10) -> Column:
    """Two half-open boxes overlap: the given one and the centre widened by the buffer."""
    low, high = size // 2 - buffer, size // 2 + buffer
    return (r0 < high) & (r1 > low) & (c0 < high) & (c1 > low)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def best_granules(scenes: DataFrame, keys: list[str], category: str, processed: str, granule: str) -> DataFrame:
    """One granule per key: tier T1 before others, then the latest processed, then the least id."""
    return first_per_key(scenes, keys, [(F.col(category) == "T1").desc(), F.col(processed).desc(), F.col(granule)])


def worst_chips(rows: DataFrame, metric: str, chip: str, k: int, larger_is_better: bool = True) -> DataFrame:
    """The k worst rows that have the metric: the smallest if larger is better, else the largest."""
    known = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return known.orderBy(F.col(metric).asc() if larger_is_better else F.col(metric).desc(), chip).limit(k)


def reference_pairs(scenes: DataFrame, limit: Column, tile: str = "tile", time: str = "acquired", granule: str = "granule_id", days: int = 90) -> DataFrame:
    """main, before, earlier: the two newest acceptable scenes before each scene, where there are two.

    ``limit`` tells which scenes may serve as references. Scenes are joined in their tile only within ``days`` days, found
    by buckets of that length, so that a tile's history doesn't meet itself as a whole.
    """
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 86400e6 / days)
    main = scenes.select(F.col(tile).alias("tile"), F.col(granule).alias("main"), F.col(time).alias("_t"), F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    refs = scenes.where(limit).select(F.col(tile).alias("tile"), F.col(granule).alias("ref"), F.col(time).alias("_r"), bucket.alias("_b"))
    near = main.join(refs, ["tile", "_b"]).where((F.col("_r") < F.col("_t")) & (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_r").cast("timestamp")) <= days * 86400e6))
    ranked = top_per_key(near, ["main"], [F.col("_r").desc(), F.col("ref")], 2)
    both = ranked.groupBy("main").agg(F.max(F.when(F.col("rank") == 1, F.col("ref"))).alias("before"), F.max(F.when(F.col("rank") == 2, F.col("ref"))).alias("earlier"))
    return both.where("earlier is not null")


def bounded_references(candidates: DataFrame, keys: list[str], order: list[Column], clear: Column, most: int, enough: int) -> DataFrame:
    """Candidates in order, up to ``most``, ending with the one that is the ``enough``-th clear one."""
    window = Window.partitionBy(*keys).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, -1)
    counted = candidates.withColumn("rank", F.row_number().over(window)).withColumn("_clear", F.coalesce(F.count_if(clear).over(running), F.lit(0)))
    return counted.where((F.col("rank") <= most) & (F.col("_clear") < enough)).drop("_clear")


def share_width(rows: DataFrame, keys: list[str], order: str, value: str, window: int, low: float, high: float) -> DataFrame:
    """keys, width: the distance between the places where the cumulative share of a line's values, each averaged with those behind it
    (``window`` in all), crosses ``low`` and ``high``. Places are between rows (linear); a share that the first row has already
    is crossed at the first row's place, taken as 0 if places count from 0.
    """
    line = Window.partitionBy(*keys)
    along = line.orderBy(order)
    smooth = rows.withColumn("_a", F.avg(value).over(along.rowsBetween(0, window - 1)))
    share = F.round(F.sum("_a").over(along.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_a").over(line), 12)
    shared = smooth.withColumn("_s", share).withColumn("_b", F.lag("_s").over(along)).withColumn("_o", F.lag(order).over(along))

    def crossing(q: float) -> Column:
        at = F.col("_o") + (q - F.col("_b")) / (F.col("_s") - F.col("_b")) * (F.col(order) - F.col("_o"))
        return F.coalesce(F.max(F.when((F.col("_s") >= q) & (F.col("_b") < q), at)), F.min(order).cast("double"))

    return shared.groupBy(*keys).agg((crossing(high) - crossing(low)).alias("width"))


def year_bands(rows: DataFrame, keys: list[str], order: list[str], first_year: int, years: int) -> DataFrame:
    """Rows in order share the years evenly: first_year, last_year of each. With more rows than years a band is at least the year it begins in."""
    whole = Window.partitionBy(*keys)
    k, n = F.row_number().over(whole.orderBy(*order)), F.count("*").over(whole)
    first = first_year + F.floor((F.col("_k") - 1) * years / F.col("_n"))
    ranked = rows.withColumns({"_k": k, "_n": n})
    return ranked.withColumns({"first_year": first.cast("int"), "last_year": F.greatest(first, first_year - 1 + F.floor(F.col("_k") * years / F.col("_n"))).cast("int")}).drop("_k", "_n")


def scene_plan(rows: DataFrame, keys: list[str], limit: float, buckets: tuple[str, str] | None = None) -> DataFrame:
    """What to ask for within which range of clouds: cloud_min, cloud_max and the keys.

    With ``buckets``, columns of a range, every row counts in its own (rows without one in none); else distinct keys from 0 to ``limit``.
    """
    if buckets:
        low, high = buckets
        return rows.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(F.col(low).cast("double").alias("cloud_min"), F.col(high).cast("double").alias("cloud_max"), *keys)
    return rows.select(*keys).distinct().select(F.lit(0.0).alias("cloud_min"), F.lit(float(limit)).alias("cloud_max"), *keys)
