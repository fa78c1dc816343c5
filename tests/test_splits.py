"""Scores of splits against a plain reading of the definition."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathlab.operators import sampling


def variation(a, b):
    return np.std([a, b]) / (np.mean([a, b]) + 1e-6)


@pytest.mark.parametrize(("potency", "seasonal"), [(1.0, False), (2.0, True)])
def test_split_scores(spark, potency, seasonal):
    rng = random.Random(4)
    rows = [(rng.randrange(25), rng.choice("abc"), rng.choice(["winter", "spring", "fall"]), rng.choice([None, rng.random(), rng.random()])) for _ in range(300)]
    rows += [(99, "rare", "winter", 0.5), (98, None, "winter", 0.1), (97, None, "spring", 0.4), (3, "a", "summer", 0.2)]
    table = spark.createDataFrame(rows, "tile int, region string, season string, cloud double")
    seeds, weights = list(range(8)), {"proportion": 2.0, "temporal": 0.5, "cloud": 3.0}
    first = {(r["tile"], r["seed"]): r["u"] < 0.4 for r in table.select("tile").distinct().withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("u", sampling.hashed("tile", F.col("seed"))).collect()}
    found = {r["seed"]: r for r in sampling.split_scores(table, "tile", "region", ["cloud"], seeds, 0.4, weights, "season" if seasonal else None, potency).collect()}
    for seed in seeds:
        sides = [[r for r in rows if first[r[0], seed] == on] for on in (True, False)]
        scores = {"proportion": 0.0, "temporal": 0.0, "cloud": 0.0}
        for region in {r[1] for r in rows}:
            own = [[r for r in side if r[1] == region] for side in sides]
            if not all(own):
                scores["proportion"] += 1000
                continue
            scores["proportion"] += variation(*(len(o) / len(s) for o, s in zip(own, sides, strict=True))) ** potency
            seasons = {r[2] for o in own for r in o}
            for season in seasons if seasonal else ():
                shares = [sum(r[2] == season for r in o) / len(o) for o in own]
                scores["temporal"] += 10 * potency / len(seasons) if min(shares) == 0 else variation(*shares)
            known = [[r[3] for r in o if r[3] is not None] for o in own]
            if all(known):
                scores["cloud"] += variation(*map(np.mean, known))
        for name, value in scores.items():
            assert math.isclose(found[seed][name], value, rel_tol=1e-9, abs_tol=1e-12), (seed, name)
        assert math.isclose(found[seed]["score"], sum(weights[k] * v for k, v in scores.items()))
    best = sampling.best_split(spark.createDataFrame([(r["seed"], r["score"]) for r in found.values()] + [(77, 0.25), (76, 0.25)], "seed int, score double")).first()
    assert best["seed"] == min([*((r["score"], r["seed"]) for r in found.values()), (0.25, 76)])[1]
