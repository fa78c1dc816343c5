"""False-positive and detection-probability curves, thresholds, recall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interp import interpolate_array
from .plumes import component_areas, label_chips

# Upper ends of the emission bins (kg/h), and the five runs of the emission grid (start, end, step).
EMISSION_BINS = (100, 200, 300, 500, 750, 1250)
EMISSION_RUNS = ((100, 1000, 100), (1000, 2000, 200), (2000, 4000, 400), (4000, 10000, 1000), (10000, 25100, 5000))


def emission_grid() -> list[int]:
    """The 29 rates."""
    return [x for start, end, step in EMISSION_RUNS for x in range(start, end, step)]


def emission_bin(rate: Column) -> Column:
    """The bin's number: (0, 100] is 0 ... above 1250 is 6; null for 0 or less."""
    out = F.when(rate > 0, F.lit(len(EMISSION_BINS)))
    for i in reversed(range(len(EMISSION_BINS))):
        out = F.when((rate > 0) & (rate <= EMISSION_BINS[i]), F.lit(i)).otherwise(out)
    return out


def with_thresholds(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each row with each threshold; for tables that are small per region (components, chips)."""
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def counts_above(scores: DataFrame, keys: list[str], score: Column, thresholds: list[float], strict: bool = True) -> DataFrame:
    """n (rows above each threshold) and rows (all of the key's): one conditional count per threshold in a single aggregate, then unpivoted."""
    above = [F.count_if(score > t if strict else score >= t) for t in thresholds]
    one = scores.groupBy(*keys).agg(F.array(*above).alias("_n"), F.count("*").alias("rows"))
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds]).alias("t"), F.col("_n").alias("n")))
    return one.select(*keys, "rows", pairs.alias("_p")).select(*keys, F.col("_p.t").alias("threshold"), F.col("_p.n").alias("n"), "rows")


def ccdf(components: DataFrame, areas: DataFrame, region: str, score: str, thresholds: list[float], crop_km2: float, tile_km2: float, strict: bool = True) -> DataFrame:
    """False-positive plumes per km2 and per tile above each threshold. ``areas``: region, crops."""
    counted = counts_above(components, [region], F.col(score), thresholds, strict).join(areas, region)
    per_km2 = F.col("n") / (F.col("crops") * crop_km2)
    return counted.select(region, "threshold", per_km2.alias("per_km2"), (per_km2 * tile_km2).alias("per_tile"))


def threshold_for_rate(curve: DataFrame, rates: list[float]) -> DataFrame:
    """The threshold (times 10, three digits) at which the regions' mean curve has each rate.

    The curve has a row per threshold given in code, so its arrays are bounded.
    """
    mean = curve.groupBy("threshold").agg(F.round(F.avg("per_tile"), 9).alias("y"))
    order = F.sort_array(F.collect_list(F.struct("y", (-F.col("threshold")).alias("t"))))
    arrays = mean.agg(order.alias("k")).select(F.transform("k", lambda x: x["y"]).alias("xs"), F.transform("k", lambda x: -x["t"]).alias("ys"))
    rows = arrays.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return rows.select("rate", F.round(interpolate_array(F.col("rate"), F.col("xs"), F.col("ys")) * 10, 3).alias("threshold"))


def detection_probability(scores: DataFrame, keys: list[str], crop: str, detected: Column) -> DataFrame:
    """Per crop the share of detected plumes (a missing score isn't detected); then mean and population deviation over crops, in percent."""
    per = scores.groupBy(*keys, crop).agg(F.avg(F.coalesce(detected, F.lit(False)).cast("double")).alias("_p"))
    return per.groupBy(*keys).agg((100 * F.avg("_p")).alias("mean"), (100 * F.stddev_pop("_p")).alias("std"))


def detection_by_rate(scores: DataFrame, keys: list[str], crop: str, score: Column, thresholds: dict[float, float]) -> DataFrame:
    """``detection_probability`` at the threshold of each false-positive rate: fpr, keys, mean, std. One pass for all (they are given in code)."""
    found = [F.avg(F.coalesce(score > t, F.lit(False)).cast("double")) for t in thresholds.values()]
    per = scores.groupBy(*keys, crop).agg(F.array(*found).alias("_p"))
    one = [F.struct(F.lit(float(fpr)).alias("fpr"), (100 * F.avg(F.col("_p")[i])).alias("mean"), (100 * F.stddev_pop(F.col("_p")[i])).alias("std")) for i, fpr in enumerate(thresholds)]
    return per.groupBy(*keys).agg(F.array(*one).alias("_r")).select(*keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")


def pixel_recall(hits: DataFrame, keys: list[str], crop: str, pairs: list[tuple[float, float]]) -> DataFrame:
    """Mean and population deviation over crops, in percent, of the pixel recall at each (marker, floor): keys, marker, floor, mean, std.

    ``hits``: of ``plumes.component_hits``. A plume's recall is the share of its pixels in components; one without pixels is
    skipped, a crop without any counts as 0.
    """
    recall = [F.avg(F.when(F.col("n") > 0, F.col("hits")[i] / F.col("n"))) for i in range(len(pairs))]
    crops = hits.groupBy(*keys, crop).agg(F.array(*[F.coalesce(r, F.lit(0.0)) for r in recall]).alias("_r"))
    one = [F.struct(F.lit(m).alias("marker"), F.lit(f).alias("floor"), (100 * F.avg(F.col("_r")[i])).alias("mean"), (100 * F.stddev_pop(F.col("_r")[i])).alias("std")) for i, (m, f) in enumerate(pairs)]
    return crops.groupBy(*keys).agg(F.array(*one).alias("_p")).select(*keys, F.explode("_p").alias("_p")).select(*keys, "_p.*")


def plume_scores(chips: DataFrame, chip: str, raster: str, size: int, region: str, floor: float) -> DataFrame:
    """region, score: the largest probability of each component at the floor; a chip that doesn't reach it counts as one of 0."""
    labelled = label_chips(chips, chip, raster, size, floor, floor, values=(raster,), keep=(region,))
    found = labelled.groupBy(chip, "label").agg(F.any_value(region).alias(region), F.max(raster).alias("score")).select(region, "score")
    return found.unionByName(chips.where(F.array_max(raster) < floor).select(region, F.lit(0.0).alias("score")))


def false_positive_area(chips: DataFrame, raster: str, size: int, region: str, pairs: list[tuple[float, float]], crops_per_tile: float) -> DataFrame:
    """Pixels per tile of the components at each (marker, floor): region, marker, floor, fp_px. One pass for all pairs."""
    areas = component_areas(chips, (region,), raster, size, pairs)
    one = [F.struct(F.lit(m).alias("marker"), F.lit(f).alias("floor"), (F.sum(F.col("areas")[i]) / F.count("*") * crops_per_tile).alias("fp_px")) for i, (m, f) in enumerate(pairs)]
    return areas.groupBy(region).agg(F.array(*one).alias("_p")).select(region, F.explode("_p").alias("_p")).select(region, "_p.*")


#: Scores are kept in this many steps.
LEVELS = 255


def score_histogram(pixels: DataFrame, region: str, chip: str, emission: Column, clean: Column, score: Column, truth: Column, predicted: Column, target: Column, bce: Column) -> DataFrame:
    """A mergeable summary of predicted pixels, from one scan: a row for each chip, level (the score in steps of 1 / ``LEVELS``) and
    truth with n, and the sums of squared errors (also on truth alone), of cross-entropy, of predictions and of their squares.

    ``bin`` and ``clean`` are the chip's emission bin and whether it has no plume. A chip has 512 rows at most, whatever its
    size, and summaries of parts are merged by adding rows. Pixels without a score have level null and are above nothing.
    """
    error = F.pow(predicted - target, 2)
    rows = pixels.select(
        region, chip, emission_bin(emission).alias("bin"), clean.alias("clean"), F.rint(score * LEVELS).cast("int").alias("level"), truth.alias("truth"), error.alias("_e"), bce.alias("_b"), predicted.alias("_p")
    )
    return rows.groupBy(region, chip, "level", "truth").agg(
        F.first("bin").alias("bin"), F.first("clean").alias("clean"), F.count("*").alias("n"), F.sum("_e").alias("error"), F.sum("_b").alias("bce"), F.sum("_p").alias("total"), F.sum(F.col("_p") * F.col("_p")).alias("squares")
    )


def false_positive_threshold(histogram: DataFrame, region: str, chip: str, thresholds: list[float], limit: float) -> DataFrame:
    """One row: the threshold at which plume-free chips have ``limit`` false-positive pixels on average, from ``score_histogram``.

    Mean per region, mean over regions, the first threshold below the limit, a linear step back; the first one if
    it is below already, the last one if none is.
    """
    above = [F.coalesce(F.sum(F.when(F.col("level") > F.lit(t) * LEVELS, F.col("n"))), F.lit(0)) for t in thresholds]
    chips = histogram.where("clean").groupBy(region, chip).agg(F.array(*above).alias("_n"))
    means = chips.groupBy(region).agg(F.array(*[F.avg(F.col("_n")[i]) for i in range(len(thresholds))]).alias("_n")).agg(F.array(*[F.avg(F.col("_n")[i]) for i in range(len(thresholds))]).alias("_n"))
    mean = means.select(F.posexplode("_n").alias("_i", "fp")).withColumn("threshold", F.get(F.lit([float(t) for t in thresholds]), F.col("_i")))
    order = Window.orderBy("threshold")  # a row per threshold given in code
    stepped = mean.select("threshold", "fp", F.lag("threshold").over(order).alias("t0"), F.lag("fp").over(order).alias("fp0"))
    at = F.when(F.col("t0").isNull(), F.col("threshold")).otherwise(F.col("t0") + (limit - F.col("fp0")) / (F.col("fp") - F.col("fp0")) * (F.col("threshold") - F.col("t0")))
    first = F.min_by(at, F.when(F.col("fp") < limit, F.col("threshold")))
    return stepped.agg(F.coalesce(first, F.max("threshold")).alias("threshold"))


def _chip_counts(histogram: DataFrame, region: str, chip: str, threshold: Column) -> DataFrame:
    """Per chip: bin, tp, tn, fp, fn at a threshold."""
    found = F.coalesce(F.col("level") > threshold * LEVELS, F.lit(False))
    counts = {"tp": found & F.col("truth"), "tn": ~found & ~F.col("truth"), "fp": found & ~F.col("truth"), "fn": ~found & F.col("truth")}
    return histogram.groupBy(region, chip).agg(F.first("bin").alias("bin"), *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in counts.items()])


def _bin_recalls() -> list[Column]:
    """Mean recall (percent) of the chips in each emission bin, 0 without chips."""
    each = 100 * F.col("tp") / (F.col("tp") + F.col("fn") + 0.00001)
    return [F.coalesce(F.avg(F.when(F.col("bin") == i, each)), F.lit(0.0)) for i in range(len(EMISSION_BINS) + 1)]


def recall_table(histogram: DataFrame, region: str, chip: str, threshold: float) -> DataFrame:
    """Mean recall (percent) of the chips of each region and emission bin, from ``score_histogram``; bins without chips have 0."""
    recalls = _chip_counts(histogram, region, chip, F.lit(float(threshold))).groupBy(region).agg(F.array(*_bin_recalls()).alias("_r"))
    return recalls.select(region, F.posexplode("_r").alias("bin", "recall"))


def validation_report(histogram: DataFrame, region: str, chip: str, thresholds: list[float], limit: float) -> DataFrame:
    """At the threshold of ``false_positive_threshold``, for each region and for all of them (region null): threshold, chips, tp, tn, fp,
    fn, precision, pixel_recall, fpr, f1; snr, mse, bce, cond_mse and loss (sums over the number of chips); recalls by emission
    bin, and recall, their mean (for all: the means of the regions'). Undefined rates are null.

    ``histogram``: of ``score_histogram``, read twice, so let it be written or cached.
    """
    found = false_positive_threshold(histogram, region, chip, thresholds, limit)
    at = histogram.crossJoin(F.broadcast(found))  # one row
    truth = F.col("truth")
    parts = {
        "_error": F.sum("error"), "_bce": F.sum("bce"), "_cond": F.sum(F.when(truth, F.col("error"))), "_on": F.sum(F.when(truth, F.col("n"))), "_on_total": F.sum(F.when(truth, F.col("total"))),
        "_off": F.sum(F.when(~truth, F.col("n"))), "_off_total": F.sum(F.when(~truth, F.col("total"))), "_off_squares": F.sum(F.when(~truth, F.col("squares"))),
    }
    above = F.coalesce(F.col("level") > F.col("threshold") * LEVELS, F.lit(False))
    cells = {"tp": above & truth, "tn": ~above & ~truth, "fp": above & ~truth, "fn": ~above & truth}
    per_chip = at.groupBy(region, chip).agg(
        F.first("threshold").alias("threshold"), F.first("bin").alias("bin"), *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in cells.items()], *[v.alias(k) for k, v in parts.items()]
    )
    sums = [F.first("threshold").alias("threshold"), *[F.sum(c).alias(c) for c in (*cells, *parts)]]
    per = per_chip.groupBy(region).agg(F.count("*").alias("chips"), F.array(*_bin_recalls()).alias("recalls"), *sums)
    n = len(EMISSION_BINS) + 1
    every = per.agg(F.sum("chips").alias("chips"), F.array(*[F.avg(F.col("recalls")[i]) for i in range(n)]).alias("recalls"), *sums).withColumn(region, F.lit(None).cast(per.schema[region].dataType))
    both = per.unionByName(every)
    noise = F.col("_off_squares") / F.col("_off") - F.pow(F.col("_off_total") / F.col("_off"), 2)
    tp, fp, fn, chips = (F.col(c) for c in ("tp", "fp", "fn", "chips"))
    return both.select(
        region, "threshold", "chips", "tp", "tn", "fp", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("pixel_recall"), F.try_divide(fp, fp + F.col("tn")).alias("fpr"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(F.col("_on_total") / F.col("_on"), F.sqrt(F.greatest(noise, F.lit(0.0)))).alias("snr"), (F.col("_error") / chips).alias("mse"),
        (F.col("_bce") / chips).alias("bce"), (F.coalesce("_cond", F.lit(0.0)) / chips).alias("cond_mse"), ((F.col("_bce") + F.coalesce("_cond", F.lit(0.0))) / chips).alias("loss"),
        "recalls", (F.aggregate("recalls", F.lit(0.0), lambda a, r: a + r) / n).alias("recall"),
    )


def pod_levels(curve: DataFrame, keys: list[str], rate: str, pod: str, levels: tuple[float, ...] = (10, 50, 90)) -> DataFrame:
    """The rates (whole, half to even) at which a detection curve reaches the levels; ``minimum``: the rate of the least POD above
    0.01 (null if there is none). The rate at the least level is ``minimum`` at least."""
    knot = F.struct(F.col(pod).alias("y"), F.col(rate).cast("double").alias("x"))
    listed = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(knot)).alias("k"), F.min(F.when(F.col(pod) > 0.01, knot)).alias("_least"))
    xs, ys = F.transform("k", lambda p: p["y"]), F.transform("k", lambda p: p["x"])
    least = F.col("_least.x").cast("long")
    out = {f"pod{int(p)}": F.rint(interpolate_array(F.lit(float(p)), xs, ys)).cast("long") for p in levels}
    first = f"pod{int(min(levels))}"
    return listed.select(*keys, *[(F.greatest(v, least) if k == first else v).alias(k) for k, v in out.items()], least.alias("minimum"))


def mean_recall(table: DataFrame, region: str) -> DataFrame:
    """One row: recall averaged over bins, then regions."""
    return table.groupBy(region).agg(F.avg("recall").alias("_r")).agg(F.avg("_r").alias("recall"))
