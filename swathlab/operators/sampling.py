"""Sampling and splits by hashes of keys: the same rows every time, on any partitioning."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import string_seed, uniform


def hashed(*parts: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) from the parts' text and a seed."""
    return uniform(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts], F.lit(seed)))


def quotas(counts: DataFrame, total: int, share: str) -> DataFrame:
    """Regions' shares times a total, half to even."""
    return counts.withColumn("quota", F.rint(F.col(share) * total).cast("long"))


def stratified(rows: DataFrame, stratum: str, key: str, wanted: DataFrame, seed: str) -> DataFrame:
    """Rows with ``copies`` such that each stratum has its quota: all rows as often as they fit, the rest by hash order."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_m"))
    order = Window.partitionBy(stratum).orderBy(hashed(key, seed=seed), key)
    ranked = rows.withColumn("_n", F.row_number().over(order)).join(sizes.join(wanted, stratum), stratum)
    copies = F.floor(F.col("quota") / F.col("_m")) + (F.col("_n") <= F.col("quota") % F.col("_m")).cast("long")
    return ranked.withColumn("copies", copies).where("copies > 0").drop("_n", "_m", "quota")


def split(rows: DataFrame, by: list[str], shares: dict[str, float], seed: str = "") -> DataFrame:
    """Rows with ``side``, by the hash of the columns: equal keys are on one side. What the shares leave over is null."""
    u, at, side = hashed(*by, seed=seed), 0.0, F.lit(None).cast("string")
    bounds = []
    for name, share in shares.items():
        at += share
        bounds.append((at, name))
    for bound, name in reversed(bounds):
        side = F.when(u < round(bound, 12), name).otherwise(side)
    return rows.withColumn("side", side)


# Added for a region that a side lacks, per missing season (over the region's seasons), and to a mean below a fraction.
MISSING_REGION, MISSING_SEASON, MEAN_FLOOR = 1000.0, 10.0, 1e-6


def _variation(a: Column, b: Column) -> Column:
    """Population deviation of two values over their mean."""
    return F.abs(a - b) / 2 / ((a + b) / 2 + MEAN_FLOOR)


def split_scores(rows: DataFrame, tile: str, region: str, measures: list[str], seeds: list[int], share: float, weights: dict[str, float], season: str | None = None, potency: float = 1.0) -> DataFrame:
    """How evenly each seed's split of the tiles keeps the distributions: seed, proportion, temporal, the measures, score (their weighted
    sum; the least is best). The split is by the hash of tile and seed, ``share`` of the tiles on the first side.

    Over regions: the variation (deviation over mean) of the two sides' proportions, to the power ``potency``, and of their
    means of each measure; with ``season`` also that of the seasons' proportions within the region, or a penalty for a season
    that a side lacks. A region that a side lacks has the penalty alone. Missing measures don't count.

    Rows are counted once, by tile, region and season; only these counts and sums meet the seeds.
    """
    parts = [region] if season is None else [region, season]
    counted = rows.groupBy(tile, *parts).agg(F.count("*").alias("_n"), *[f(m).alias(f"_{f.__name__}_{m}") for m in measures for f in (F.sum, F.count)])
    tries = counted.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    tries = tries.withColumn("_first", hashed(tile, F.col("seed")) < share)
    values = ["_n", *[f"_{f}_{m}" for m in measures for f in ("sum", "count")]]
    sides = [F.coalesce(F.sum(F.when(on, F.col(v))), F.lit(0)).alias(f"{v}_{i}") for v in values for i, on in enumerate((F.col("_first"), ~F.col("_first")))]
    cells = tries.groupBy("seed", *parts).agg(*sides)
    seasons = F.collect_list(F.struct(F.col("_n_0").alias("a"), F.col("_n_1").alias("b"))).alias("_seasons")  # as many as there are seasons
    by_region = cells.groupBy("seed", region).agg(*[F.sum(f"{v}_{i}").alias(f"{v}_{i}") for v in values for i in (0, 1)], seasons)
    whole = Window.partitionBy("seed")  # a row per region
    by_region = by_region.withColumns({f"_whole_{i}": F.sum(f"_n_{i}").over(whole) for i in (0, 1)})
    both = (F.col("_n_0") > 0) & (F.col("_n_1") > 0)
    proportion = F.pow(_variation(F.col("_n_0") / F.col("_whole_0"), F.col("_n_1") / F.col("_whole_1")), F.lit(potency))

    def one_season(x: Column) -> Column:
        gap = _variation(x["a"] / F.col("_n_0"), x["b"] / F.col("_n_1"))
        return F.when((x["a"] == 0) | (x["b"] == 0), F.lit(MISSING_SEASON * potency) / F.size("_seasons")).otherwise(gap)

    temporal = F.aggregate("_seasons", F.lit(0.0), lambda total, x: total + one_season(x)) if season else F.lit(0.0)
    means = {m: _variation(*[F.try_divide(F.col(f"_sum_{m}_{i}"), F.col(f"_count_{m}_{i}")) for i in (0, 1)]) for m in measures}
    scores = {"proportion": F.when(both, proportion).otherwise(MISSING_REGION), "temporal": F.when(both, temporal), **{m: F.when(both, v) for m, v in means.items()}}
    found = by_region.groupBy("seed").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in scores.items()])
    return found.withColumn("score", sum((F.lit(float(weights.get(k, 1.0))) * F.col(k) for k in scores), F.lit(0.0)))


def best_split(scores: DataFrame) -> DataFrame:
    """The row of the most even split of ``split_scores``, to nine digits; of equal ones the least seed."""
    return scores.withColumn("score", F.round("score", 9)).orderBy("score", "seed").limit(1)


def ordered_split(rows: DataFrame, key: str, share: float, cell: Column) -> DataFrame:
    """The first share of the rows by key is ``train``, the rest ``val``.

    Ranks are counted in two steps: within cells (``cell`` rises with the key), then over them.
    """
    cells = rows.withColumn("_c", cell)
    sizes = cells.groupBy("_c").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    ranked = cells.withColumn("_k", F.row_number().over(Window.partitionBy("_c").orderBy(key))).join(sizes, "_c")
    side = F.when(F.col("_before") + F.col("_k") <= F.floor(F.col("_total") * share), "train").otherwise("val")
    return ranked.withColumn("side", side).drop("_c", "_k", "_before", "_total")


def top_up(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One row per missing item of each key: key and number (from 1), up to n items in all."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    missing = counts.where(F.col("_n") < n).select(key, (n - F.col("_n")).alias("_m"))
    return missing.select(key, F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("number"))


def pick_existing(scenes: DataFrame, tile: str, granule: str, used: DataFrame, avoid: Column, seed: str, n: int = 1) -> DataFrame:
    """n scenes per tile by hash, none that is used or to be avoided."""
    free = scenes.where(~avoid).join(used.select(granule), granule, "left_anti")
    order = Window.partitionBy(tile).orderBy(hashed(granule, seed=seed), granule)
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def number_by_table(u: Column, cumulative: list[float]) -> Column:
    """The place of u in a table of cumulative probabilities given in code."""
    out = F.lit(len(cumulative) - 1)
    for i in reversed(range(len(cumulative) - 1)):
        out = F.when(u < cumulative[i], i).otherwise(out)
    return out


def with_replacement(rows: DataFrame, key: str, n: int, seed: str, rows_per_cell: int = 4096) -> DataFrame:
    """n draws: draw and key of the row at place seed(draw) % count in the order of (hash of the key, key).

    The row's place needs a global rank: rows are counted within equal cells of hashes first, as many as the rows call for,
    then over the cells.
    """
    spark = rows.sparkSession
    total = rows.count()
    u = hashed(key, seed=seed)
    cells = rows.select(key, u.alias("_u"), F.floor(u * F.lit(float(total // rows_per_cell + 1))).alias("_c"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row for some thousands of rows
    offsets = cells.groupBy("_c").agg(F.count("*").alias("_n")).select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = cells.withColumn("_k", F.row_number().over(Window.partitionBy("_c").orderBy("_u", key))).join(offsets, "_c").select(key, (F.col("_before") + F.col("_k") - 1).alias("_at"))
    draws = spark.range(n if total else 0).withColumnRenamed("id", "draw").withColumn("_at", F.pmod(string_seed(F.concat(F.col("draw").cast("string"), F.lit(seed))), F.lit(max(total, 1))))
    return draws.join(places, "_at").select("draw", key)


def by_cascade(rows: DataFrame, levels: list[tuple[str, DataFrame]], out: str, default: str) -> DataFrame:
    """A label by the first level whose key has one. ``levels``: (column, table of that column and ``label``), of sizes bounded by their vocabularies."""
    names = []
    for i, (column, labels) in enumerate(levels):
        rows = rows.join(labels.select(column, F.col("label").alias(f"_l{i}")), column, "left")
        names.append(f"_l{i}")
    return rows.withColumn(out, F.coalesce(*names, F.lit(default))).drop(*names)


def cluster_split(rows: DataFrame, key: str, places: list[str], k: int, train: int, seed: int, rounds: int) -> DataFrame:
    """key, cluster (from 0) and side: rows by k-means on their places, ``train`` of the clusters (by hash) for training, the rest for validation.

    The centres start at the ``k`` places of the least hash of key and seed; a round assigns rows to the nearest centre (the first of
    equal ones) and moves the centres to the means (nine digits), one aggregate of at most ``k`` rows; an empty cluster keeps its centre. It stops
    early when nothing moves. Rows without a place have no cluster and are left out.
    """
    known = rows.select(key, *[F.col(c).cast("double").alias(c) for c in places]).where(functools.reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in places]))
    first = known.withColumn("_h", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)).orderBy("_h", key).limit(k).collect()
    centres = [[r[c] for c in places] for r in first]

    def nearest(to: list[list[float]]) -> Column:
        far = [functools.reduce(Column.__add__, [F.pow(F.col(c) - x, 2) for c, x in zip(places, at, strict=True)]) for at in to]
        return F.array_position(F.array(*far), F.array_min(F.array(*far))).cast("int") - 1

    for _ in range(rounds if centres else 0):
        found = known.groupBy(nearest(centres).alias("_c")).agg(*[F.round(F.avg(c), 9).alias(c) for c in places]).collect()
        means = {r["_c"]: [r[c] for c in places] for r in found}
        moved = [means.get(i, at) for i, at in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    order = sorted(range(len(centres)), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    cluster = nearest(centres) if centres else F.lit(None).cast("int")
    side = F.when(F.col("cluster").isin(order[:train]), "train").otherwise("val")
    return known.select(key, cluster.alias("cluster")).withColumn("side", side)
