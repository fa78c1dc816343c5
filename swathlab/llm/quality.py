"""Quality scores by hierarchical empirical Bayes.

A logistic classifier over words, their beginnings and binned text statistics (those that tell the classes apart by
chi-squared), fitted on a bounded sample of labelled documents, gives each document's evidence (a calibrated log-odds). Sites have two
levels, host and path. A host's rate is drawn to the global one, a path's to
its host's, by as many pseudo-documents as the spread between sites calls for (method of
moments, from grouped sums), so that sparse sites stay near their prior. A document's posterior
log-odds are its evidence plus the shift of its path's rate against the global one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, spread
from .decontamination import fold

#: Bound of the fit: labelled documents, and features kept for each target.
SAMPLE_DOCUMENTS = 20_000
KEPT_FEATURES = 320
LEAST_CHI2 = 16.0
RIDGE = 1.0
#: Lengths in bytes of the beginnings of words that are features.
BEGINNINGS = (4, 6)
_SIGNS = b"!#$%&*|"
TARGETS = ("quality", "toxic")


def features(text: str | None) -> set[bytes]:
    """Words, their beginnings, and bins of text statistics. Null counts as empty."""
    text = text or ""
    words = fold(text).split()
    n, distinct = len(words), set(words)
    raw = text.encode()
    letters = max(1, sum(map(len, words)))
    spaces = sum(map(raw.count, (b" ", b"\n", b"\t")))
    upper = sum(map(raw.count, _CAPITALS))
    lines = text.split("\n")
    stats = [
        ("length", math.log2(n + 1)), ("signs", 20 * math.sqrt(max(0, len(raw) - letters - spaces) / max(1, len(raw)))), ("capitals", 20 * math.sqrt(upper / letters)),
        ("digits", 20 * math.sqrt(sum(len(w) for w in distinct if w.isdigit()) / letters)), ("word", min(16, letters / max(1, n))),
        ("variety", 10 * len(distinct) / max(1, n) if n < 200 else 11 + 10 * len(distinct) / n), ("lines", 10 * len(set(lines)) / len(lines)),
    ]
    stats += [(f"sign{c}", 10 * math.sqrt(raw.count(c) / max(1, n))) for c in _SIGNS]
    out = distinct | {b"\x00%s=%d" % (name.encode(), int(value)) for name, value in stats}
    for k in BEGINNINGS:
        out |= {b"^" + w[:k] for w in distinct if len(w) > k}
    return out


_CAPITALS = [bytes([c]) for c in range(0x41, 0x5B)]


class Evidence:
    """Log-odds of the selected features for each target, calibrated on documents that weren't counted."""

    def __init__(self, weights: dict[str, dict[bytes, float]], lines: dict[str, tuple[float, float]]):
        self.weights, self.lines = weights, lines

    def raw(self, found: set[bytes], target: str) -> float:
        weights = self.weights[target]
        return math.fsum(weights[f] for f in found & weights.keys())

    def score(self, found: set[bytes], target: str) -> float:
        slope, offset = self.lines[target]
        return max(-12.0, min(12.0, slope * self.raw(found, target) + offset))


def _select(counts: dict[bytes, tuple[int, int]], bad: int, good: int) -> list[bytes]:
    """The features that tell the classes apart best (chi-squared)."""
    out = []
    total = bad + good
    for feature, (b, g) in counts.items():
        n = b + g
        spread = n * (total - n) * bad * good
        chi2 = total * (b * good - g * bad) ** 2 / spread if spread else 0.0
        if chi2 >= LEAST_CHI2:
            out.append((chi2, feature))
    return [f for _, f in sorted(out, key=lambda x: (-x[0], x[1]))[:KEPT_FEATURES]]


def _newton(x: np.ndarray, y: np.ndarray, centre: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression drawn to ``centre``, by Newton steps that are halved until the loss falls."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - y * z) + np.sum(ridge * (b - centre) ** 2) / 2)

    b = centre.copy()
    now = loss(b)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (b - centre))
        size = 1.0
        while (tried := loss(b + size * step)) > now and size > 1e-6:
            size /= 2
        if now - tried < 1e-7 * (1 + now):
            break
        b, now = b + size * step, tried
    return b


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset (last) of a ridge logistic regression."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    return _newton(x, y, np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, RIDGE), 1e-3))


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of a logistic line over evidence, drawn to a slope of 1."""
    slope, offset = _newton(np.column_stack([raw, np.ones(len(raw))]), y, np.array([1.0, 0.0]), np.array([2.0, 1e-3]))
    return max(0.0, float(slope)), float(offset)


def sample_labels(labels: DataFrame, id_col: str, sample: int) -> DataFrame:
    """One row per labelled id, at most ``sample`` by hash: id, targets, part. An id with differing labels takes the larger."""
    once = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    place = F.xxhash64("id", F.lit("quality"))
    return once.orderBy(place, "id").limit(sample).withColumn("part", F.pmod(place, F.lit(4)).cast("int"))


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Evidence:
    """Feature counts from three quarters of the sample, calibration on the rest."""
    labelled = sample_labels(labels, id_col, sample)
    # the sample's bound is that of the broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labelled), "id").select("text", "part", *TARGETS)
    texts = materialize(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, bytes]] = Counter()
        for batch in batches:
            for text, *values in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                found = [*features(text), b""]
                for target, value in zip(TARGETS, values, strict=True):
                    if value is not None:
                        counts.update((target, value, f) for f in found)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), pa.array([counts[k] for k in keys], pa.int64())],
            names=["target", "value", "feature", "n"],
        )

    tally = texts.where("part <> 0").mapInArrow(count, "target string, value int, feature binary, n bigint")
    good, bad = (F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("value") > 0, 0).otherwise(F.col("n"))).alias("bad"))
    # at least 8 documents for a feature to matter: what comes back is bounded by the sample
    rows = tally.groupBy("target", "feature").agg(good, bad).where((F.col("good") + F.col("bad") >= 8) | (F.col("feature") == F.lit(b""))).collect()
    chosen: dict[str, list[bytes]] = {}
    for target in TARGETS:
        counts = {bytes(r["feature"]): (r["bad"], r["good"]) for r in rows if r["target"] == target}
        n_bad, n_good = counts.pop(b"", (0, 0))
        chosen[target] = _select(counts, n_bad, n_good) if n_bad and n_good else []
    places = {t: {f: i for i, f in enumerate(chosen[t])} for t in TARGETS}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[sorted(places[t][f] for f in x & places[t].keys()) for t in TARGETS] for x in (features(text.as_py()) for text in batch.column(0))]
            held = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in range(len(TARGETS))]
            yield pa.RecordBatch.from_arrays([*held, batch.column(2), batch.column(3)], names=["has_quality", "has_toxic", *TARGETS])

    examples = texts.where("part <> 0").mapInArrow(index, "has_quality array<int>, has_toxic array<int>, quality int, toxic int").collect()
    weights: dict[str, dict[bytes, float]] = {}
    for target in TARGETS:
        known = sorted((sorted(r[f"has_{target}"]), int(r[target] > 0)) for r in examples if r[target] is not None)
        x = np.zeros((len(known), len(chosen[target])), np.float32)
        for row, (has, _) in enumerate(known):
            x[row, has] = 1
        fitted = _logistic(x, np.array([y for _, y in known])) if chosen[target] else np.zeros(1)
        weights[target] = dict(zip(chosen[target], map(float, fitted[:-1]), strict=True))
    evidence = Evidence(weights, dict.fromkeys(TARGETS, (1.0, 0.0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[evidence.raw(f, t) for t in TARGETS] for f in (features(text.as_py()) for text in batch.column(0))]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.float64()) for i in range(len(TARGETS))), batch.column(2), batch.column(3)], names=["raw_quality", "raw_toxic", *TARGETS])

    held = texts.where("part = 0").mapInArrow(score, "raw_quality double, raw_toxic double, quality int, toxic int").collect()
    for target in TARGETS:
        some = sorted((r[f"raw_{target}"], r[target]) for r in held if r[target] is not None)
        if some:
            raw, y = np.array([x for x, _ in some]), np.array([float(v > 0) for _, v in some])
            evidence.lines[target] = _calibrate(raw, y)
    return evidence


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _sites(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{t}").alias(f"sum_{t}") for t in TARGETS])


def _strength(sites: DataFrame, target: str) -> Column:
    """Pseudo-documents: rate * (1 - rate) / spread between sites - 1, within 1 to 1000; a single site gives 1000."""
    n, s = F.col("n"), F.col(f"sum_{target}")
    rate = F.try_divide(F.sum(s), F.sum(n))
    square = F.try_divide(F.sum(s * s / n), F.sum(n))  # weighted mean of squared rates
    spread = square - rate * rate - F.try_divide(F.count("*") * rate * (1 - rate), F.sum(n))
    return F.coalesce(F.least(F.greatest(F.try_divide(rate * (1 - rate), F.greatest(spread, F.lit(1e-9))) - 1, F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """One row per document: id, and for both targets evidence, prior and score; keep and toxic.

    ``<target>_evidence``: calibrated log-odds; ``<target>_prior``: the path's rate, without the document itself;
    ``<target>_score``: posterior probability. ``keep``: quality of 1/2 or more; ``toxic``: toxicity of 1/2 or more. A
    site's rate rests on labels where there are any, else on the documents' own probabilities.
    Null texts count as empty, null hosts and paths are sites; without labels all evidence is 0. Very long texts are read
    whole, one at a time. An empty table gives an empty result. Repeated rows are rows of their own; labels for unknown documents are left out.
    """
    evidence = fit_evidence(docs, labels, id_col, text_col, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text's features at a time
            found = [[evidence.score(f, t) for t in TARGETS] for f in (features(text.as_py()) for text in batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[i] for x in found], pa.float64()) for i in range(len(TARGETS)))], names=["id", "host", "path", *TARGETS_EVIDENCE])

    kept = spread(docs).select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    scored = kept.mapInArrow(score, f"id {kind}, host string, path string, quality_evidence double, toxic_evidence double")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(t).cast("double").alias(f"known_{t}") for t in TARGETS])
    scored = materialize(scored.join(known, "id", "left"))
    own = {t: F.coalesce(f"known_{t}", 1 / (1 + F.exp(-F.col(f"{t}_evidence")))) for t in TARGETS}
    # paths by a hash of host and path, so that a null is a value like others
    scored = scored.withColumns({f"own_{t}": own[t] for t in TARGETS}).withColumn("host_key", F.xxhash64("host")).withColumn("path_key", F.xxhash64("host", F.lit("/"), "path"))
    paths = materialize(scored.groupBy("host_key", "path_key").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"own_{t}").alias(f"sum_{t}") for t in TARGETS]))
    hosts = _sites(paths, ["host_key"], "quality")
    top = _sites(hosts, [], "quality").select(*[F.try_divide(F.col(f"sum_{t}"), F.col("n")).alias(f"rate_{t}") for t in TARGETS])
    host_strength = hosts.agg(*[_strength(hosts, t).alias(f"host_strength_{t}") for t in TARGETS])
    path_strength = paths.agg(*[_strength(paths, t).alias(f"path_strength_{t}") for t in TARGETS])
    overall = {k: v for frame in (top, host_strength, path_strength) for k, v in frame.first().asDict().items()}
    rates = hosts.select("host_key", F.col("n").alias("host_n"), *[F.col(f"sum_{t}").alias(f"host_{t}") for t in TARGETS])
    sites = paths.join(rates, "host_key")
    joined = apart(scored, "path_key").join(apart(sites.drop("host_key"), "path_key"), ["path_key", "_apart"])
    for t in TARGETS:
        rate = F.lit(overall[f"rate_{t}"] if overall[f"rate_{t}"] is not None else 0.5)
        host = (F.col(f"host_{t}") - F.col(f"own_{t}") + F.lit(overall[f"host_strength_{t}"]) * rate) / (F.col("host_n") - 1 + F.lit(overall[f"host_strength_{t}"]))
        path = (F.col(f"sum_{t}") - F.col(f"own_{t}") + F.lit(overall[f"path_strength_{t}"]) * host) / (F.col("n") - 1 + F.lit(overall[f"path_strength_{t}"]))
        joined = joined.withColumn(f"{t}_prior", path)
        joined = joined.withColumn(f"{t}_score", 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + _logit(F.col(f"{t}_prior")) - _logit(rate)))))
    return joined.select(
        "id", *[f"{t}_{x}" for t in TARGETS for x in ("evidence", "prior", "score")], (F.col("quality_score") >= 0.5).alias("keep"), (F.col("toxic_score") >= 0.5).alias("toxic")
    )


TARGETS_EVIDENCE = tuple(f"{t}_evidence" for t in TARGETS)
