"""SimHash near-duplicates found through covering masks.

Bit i of a fingerprint has a code word of radius + 1 bits. A mask keeps the bits whose code
word has an odd product with one of the 2**(radius + 1) - 1 non-zero vectors. For any
``radius`` bits some vector is orthogonal to all their code words, so two fingerprints that
differ in no more than those bits are equal under its mask: no pair in the radius is missed.

Documents are first reduced to their distinct fingerprints. Buckets of up to ``PAIRED``
fingerprints are compared pair by pair. In larger ones, every fingerprint goes to the points
at one changed bit (of those the mask drops) or none, and is tied to the least
fingerprint of each point: two fingerprints share a point exactly if they differ in 2
bits or fewer, so that is whole too, and linear in the bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, partitions, row_key, spread
from .components import connected_components

BITS = 64
#: Fixed: the points of larger buckets rest on it.
RADIUS = 2
SHINGLE = 3
PAIRED = 32
SEED = 42
_CHUNK = 1 << 16


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks, as unsigned integers; code words 1, 2, ... in turn are dealt to the bits."""
    words = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, w in enumerate(words) if (w & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed integer; 0 for a text without words, or null."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(runs), _CHUNK):
        some = runs[at : at + _CHUNK]
        hashes = np.fromiter((digest(x, SEED) for x in some), "<u8", len(some))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(runs), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, row_key, fp."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return spread(docs).select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), fp(F.col(text_col)).alias("fp"))


def near_links(classes: DataFrame) -> DataFrame:
    """Edges (left, right) between distinct fingerprints ``fp`` that join all that differ in ``RADIUS`` bits or fewer.

    Every edge is a true link; every true link's ends are joined by an edge, or by two edges
    through a fingerprint linked to both. A point has at most 65 fingerprints.
    """
    masks = covering_masks()
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("at")).select("fp", "at.*")
    filled = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(apart(keyed, "mask", "key").join(apart(filled, "mask", "key"), ["mask", "key", "_apart"]).drop("_apart"))

    small = shared.where(F.col("n") <= PAIRED).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps", F.explode("fps").alias("left")).select("left", F.explode("fps").alias("right"))
    pairs = pairs.where((F.col("left") < F.col("right")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= RADIUS)).distinct()

    flips = [(i, 1 << b) for i, m in enumerate(masks) for b in range(BITS) if not m >> b & 1]
    near = F.create_map(*[x for i in range(len(masks)) for x in (F.lit(i), F.array(F.lit(0).cast("long"), *[F.lit(_signed(f)) for j, f in flips if i == j]))])
    points = shared.where(F.col("n") > PAIRED).select("fp", F.explode(F.element_at(near, F.col("mask"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    ties = apart(points, "point").join(apart(hubs, "point"), ["point", "_apart"]).where("fp <> hub").select(F.col("hub").alias("left"), F.col("fp").alias("right")).distinct()
    return pairs.unionByName(ties)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, row_key, fp, root, component_id.

    ``root``: the least fingerprint reachable by links; ``component_id``: the least id there.
    Null, empty and blank texts have fingerprint 0 and are linked like others. A null id takes part but is a
    component's id only if all are null. Very long texts are read whole. Repeated rows are rows of their own. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    classes = materialize(classes.repartition(partitions(docs.sparkSession), "fp"))  # every row of it makes several
    roots = connected_components(near_links(classes), "left", "right").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = materialize(apart(rooted, "root").join(apart(least, "root"), ["root", "_apart"]).select("fp", "root", "component_id"))
    return apart(marked, "fp").join(apart(rooted, "fp"), ["fp", "_apart"]).drop("_apart")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents with one of each component left: that with the least id (nulls last), then the least key.

    Repeated rows (equal id and text) count as one. Columns are those of ``docs``.
    """
    marked = simhash_components(docs, id_col, text_col, shingle)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    chosen = marked.groupBy("root").agg(F.min(best).alias("best")).select(F.col("best.id").alias("_id"), F.col("best.row_key").alias("_key"))
    packed = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_doc"))
    same = (packed["_key"] == chosen["_key"]) & packed["_id"].eqNullSafe(chosen["_id"])
    return packed.join(chosen, same, "left_semi").dropDuplicates(["_key", "_id"]).select("_doc.*")
