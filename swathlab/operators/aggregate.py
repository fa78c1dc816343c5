"""Aggregates: confusion metrics, percentages, statistics. Undefined rates are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pixels: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """tp, tn, fp, fn, positives, negatives of each group."""
    return pixels.groupBy(*keys).agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(~predicted & ~truth).alias("tn"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"),
        F.count_if(truth).alias("positives"), F.count_if(~truth).alias("negatives"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """FPR, FNR, TNR, recall, precision and F1 of confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {
            "fpr": F.try_divide(fp, fp + tn), "fnr": F.try_divide(fn, fn + tp), "tnr": F.try_divide(tn, fp + tn),
            "recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def mse_per_sample(pixels: DataFrame, keys: list[str], predicted: Column, target: Column, sample: str) -> DataFrame:
    """Sum of squared errors over the number of samples (not pixels). Two steps, so that no distinct count is kept."""
    per = pixels.groupBy(*keys, sample).agg(F.sum(F.pow(target - predicted, 2)).alias("_e"))
    return per.groupBy(*keys).agg((F.sum("_e") / F.count("*")).alias("mse"))


def signal_to_noise(pixels: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Mean where true over the population deviation elsewhere; null if that is 0."""
    noise = F.stddev_pop(F.when(~truth, predicted))
    return pixels.groupBy(*keys).agg(F.try_divide(F.avg(F.when(truth, predicted)), noise).alias("snr"))


def state(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """A mergeable state: n, mean, var (population)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of parts to that of the whole: within-part and between-part variance."""
    n = F.sum("n")
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), n)
    square = F.try_divide(F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))), n)
    return states.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), (square - mean * mean).alias("var"))


def with_overall(rows: DataFrame, key: str, aggregates: list[Column], label: str = "overall") -> DataFrame:
    """Aggregates of each group and of all rows; the key as text, ``label`` for all."""
    rolled = rows.rollup(key).agg(*aggregates, F.grouping(key).alias("_all"))
    return rolled.withColumn(key, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))).drop("_all")


def reference_quality(pixels: DataFrame, keys: list[str], main: Column, ref: Column, cloud: Column, shadow: Column, nodata: Column) -> DataFrame:
    """overlap, cloud, shadow (over the overlap + 0.01) and nodata (over the main's valid pixels), in percent."""
    both = F.count_if(main & ref)
    over = both + 0.01
    return pixels.groupBy(*keys).agg(
        (100 * F.try_divide(both, F.count_if(main))).alias("overlap"), (100 * F.count_if(main & ref & cloud) / over).alias("cloud"),
        (100 * F.count_if(main & ref & shadow) / over).alias("shadow"), (100 * F.try_divide(F.count_if(main & nodata), F.count_if(main))).alias("nodata"),
    )


def class_shares(pixels: DataFrame, keys: list[str], klass: str, classes: list[int], valid: Column) -> DataFrame:
    """Percent of each class among valid pixels (+ 0.001), percent without data among all; one row per group."""
    n = F.count_if(valid) + 0.001
    return pixels.groupBy(*keys).agg((100 * F.count_if(~valid) / F.count("*")).alias("nodata"), *[(100 * F.count_if(valid & (F.col(klass) == c)) / n).alias(f"class_{c}") for c in classes])


def with_group_mean(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Missing values replaced by their group's mean."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return rows.join(means, keys).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def welch(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """Means, variances, t and the Welch-Satterthwaite degrees of freedom of two groups (true, false)."""
    a, b = F.when(group, value), F.when(~group, value)
    va, vb = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    return rows.agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"), ((F.avg(a) - F.avg(b)) / F.sqrt(va + vb)).alias("t"),
        (F.pow(va + vb, 2) / (va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1))).alias("df"),
    )


def error_summary(rows: DataFrame, keys: list[str], errors: list[str]) -> DataFrame:
    """Mean absolute, root mean square and mean of relative errors, by group and method (long form)."""
    stack = F.explode(F.map_from_arrays(F.array(*[F.lit(e) for e in errors]), F.array(*errors))).alias("method", "error")
    return rows.select(*keys, stack).groupBy(*keys, "method").agg(F.avg(F.abs("error")).alias("mape"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmspe"), F.avg("error").alias("mpe"))


def share_map(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A map from value to its share in each group."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    shares = counts.withColumn("_share", F.round(F.col("_n") / total, 9))
    return shares.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "_share")))).alias("shares"))


def counts_by_thresholds(rows: DataFrame, keys: list[str], names: dict[str, str], score: Column, pairs: list[tuple[float, ...]]) -> DataFrame:
    """keys, the thresholds of each tuple (names), and how many rows reach each of them (the names' values).

    A conditional count for each threshold in one aggregate: rows aren't multiplied, and groups come back with a row for each tuple.
    """
    distinct = sorted({t for pair in pairs for t in pair})
    counted = rows.groupBy(*keys).agg(F.array(*[F.count_if(score >= t) for t in distinct]).alias("_n"))
    one = lambda pair: F.struct(*[F.lit(t).alias(n) for n, t in zip(names, pair, strict=True)], *[F.col("_n")[distinct.index(t)].alias(c) for c, t in zip(names.values(), pair, strict=True)])
    return counted.select(*keys, F.explode(F.array(*[one(p) for p in pairs])).alias("_p")).select(*keys, "_p.*")
