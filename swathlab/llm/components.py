"""Connected components of an edge table, in rounds of large-star and small-star steps.

Rounds are few (logarithmic in a component's length). Every round's edges go to the
checkpoint folder; the driver sees their count and checksum only. Joins are written so that
adaptive execution can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize

MAX_ROUNDS = 60


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """For each ``a``: its neighbours ``b`` are tied to the least of them and ``a``."""
    least = apart(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")
    if not small:
        least = least.withColumn("m", F.least("a", "m"))
    tied = apart(pairs, "a").join(least, ["a", "_apart"])
    out = tied.where("b <> m" if small else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row per node that has an edge: node, root (the least node it reaches).

    Repeated edges, both directions and loops are allowed; null ends are left out. Nodes are
    integers. Raises RuntimeError if ``max_rounds`` rounds don't suffice, rather than return
    a partial result.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"`{left}` <> `{right}`").distinct()
    pairs = materialize(pairs)
    before = None
    for _ in range(max_rounds):
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = materialize(_star(_star(both, small=False), small=True))
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
