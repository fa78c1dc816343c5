"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the exact norm of what is lost bounds the error of
every product: |u.v - u'.v'| <= |u'| |v - v'| + |u - u'|. Tiles hold the codes alone, and integer products tell
pairs that surely reach the threshold from those that can't. Vectors with a pair in between go to the pair of tiles where it arose, and
such pairs, no others, are computed there in double precision.

Equal vectors are one row from the start. Vectors are dealt to tiles of about ``TILE_ROWS``
by hash, and each pair of tiles is one bounded group. A group returns the number of links of each vector, a tie of
each to the least vector that its links reach, and the vectors with pairs in between. No pairs leave a group, so what it returns grows with its
vectors, however dense they lie at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, materialize
from .components import connected_components

THRESHOLD = 0.95
TILE_ROWS = 4096
_BLOCK = 1024
#: Above the rounding of 64-bit sums; integer products are exact.
_SLACK = 1e-9
#: Components whose products 32-bit floats add up exactly: 1024 * 127 * 127 < 2**24.
_EXACT = 1024
#: Pairs computed in double precision at once.
_PAIRS = 16384


def usable(vector: Column) -> Column:
    """Whether a vector can link: no null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def _forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of (left, right) that join what ``labels`` has apart; labels are merged in place."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        a, b = labels[left], labels[right]
        cross = a != b
        if not cross.any():
            break
        left, right, a, b = left[cross], right[cross], a[cross], b[cross]
        _, chosen = np.unique(np.maximum(a, b), return_index=True)  # a larger label is tied once
        kept.append((left[chosen], right[chosen]))
        parent = np.arange(len(labels))
        parent[np.maximum(a, b)[chosen]] = np.minimum(a, b)[chosen]
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        labels[:] = parent[labels]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])


def _unit(vectors: pa.ListArray, n: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    values = values / np.abs(values).max(axis=1, initial=1e-300)[:, None]
    return values / np.linalg.norm(values, axis=1)[:, None]


def quantised(classes: DataFrame) -> DataFrame:
    """``classes`` (node, copies, least, vector) with each vector's length, code (int8 bytes), scale, lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(3)).to_numpy()
            for length in np.unique(lengths):
                some = batch.filter(pa.array(lengths == length))
                codes, scale, lost = quantise(_unit(some.column(3), some.num_rows))
                added = [pa.array(np.full(some.num_rows, length, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(lost)]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*some.schema.names, "length", "code", "scale", "lost"])

    given = classes.select("node", "copies", "least", "vector")
    added = [T.StructField("length", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("lost", T.DoubleType())]
    return given.mapInArrow(run, T.StructType([*given.schema.fields, *added]))


def near_pairs(codes: np.ndarray, scale: np.ndarray, lost: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block (left, right, whether they surely link) of the pairs of rows ``first`` and ``second`` (the same array: within it) that may reach the threshold."""
    whole = codes.astype(np.float32)
    size = np.linalg.norm(codes * scale[:, None], axis=1)
    within = first is second
    for at in range(0, len(first), _BLOCK):
        rows = first[at : at + _BLOCK]
        others = second[at:] if within else second
        products = whole[rows, :_EXACT] @ whole[others, :_EXACT].T
        for k in range(_EXACT, codes.shape[1], _EXACT):
            products = products.astype(np.float64) + whole[rows, k : k + _EXACT] @ whole[others, k : k + _EXACT].T
        # a coarse bound for all pairs, with room for its own rounding; the exact one for those that it leaves
        least = (threshold - _SLACK - lost[rows] - size[rows] * lost[others].max(initial=0)) / scale[rows] - 1e-5 / scale[rows]
        i, j = np.nonzero(products * scale[others][None, :].astype(products.dtype) >= least[:, None].astype(products.dtype))
        if within:
            i, j = i[j > i], j[j > i]
        left, right = rows[i], others[j]
        near = products[i, j].astype(np.float64) * scale[left] * scale[right]
        error = size[left] * lost[right] + lost[left] + _SLACK
        possible = near + error >= threshold
        yield left[possible], right[possible], (near - error >= threshold)[possible]


def compare_tiles(
    codes: np.ndarray, scale: np.ndarray, lost: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD, unit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, labels of what they join, whether the row has pairs in between) of the rows ``first`` and ``second``.

    Without ``unit`` the links are the sure ones; with the unit vectors they are those of the pairs in between, in double precision.
    """
    links, labels, between = np.zeros(len(codes), np.int64), np.arange(len(codes)), np.zeros(len(codes), bool)
    for left, right, sure in near_pairs(codes, scale, lost, first, second, threshold):
        between[left[~sure]] = between[right[~sure]] = True
        if unit is not None:
            left, right = left[~sure], right[~sure]
            reached = [np.einsum("ij,ij->i", unit[left[k : k + _PAIRS]], unit[right[k : k + _PAIRS]]) >= threshold for k in range(0, len(left), _PAIRS)]
            sure = np.concatenate([np.zeros(0, bool), *reached])
        left, right = left[sure], right[sure]
        links += np.bincount(left, copies[right], len(codes)).astype(np.int64) + np.bincount(right, copies[left], len(codes)).astype(np.int64)
        _forest(labels, left, right)
    return links, labels, between


_FOUND = "length int, low int, high int, tile int, node bigint, links bigint, other bigint, open boolean"


def _group(tiles: pa.Table, threshold: float) -> pa.Table:
    """Rows of ``_FOUND`` of one pair of tiles: each vector that has links, is tied to another, or has pairs in between (``open``).

    Tiles with a column ``vector`` hold such vectors only, and the links are those of their pairs in between.
    """
    codes = np.frombuffer(b"".join(tiles.column("code").to_pylist()), np.int8).reshape(tiles.num_rows, -1)
    tile, node, copies, scale, lost = (tiles.column(c).to_numpy() for c in ("tile", "node", "copies", "scale", "lost"))
    first = np.flatnonzero(tile == tiles.column("low")[0].as_py())
    second = first if tiles.column("low")[0] == tiles.column("high")[0] else np.flatnonzero(tile == tiles.column("high")[0].as_py())
    settled = "vector" in tiles.column_names
    unit = _unit(tiles.column("vector").combine_chunks(), tiles.num_rows) if settled else None
    links, labels, between = compare_tiles(codes, scale, lost, copies, first, second, threshold, unit)
    least = node.copy()
    np.minimum.at(least, labels, node)
    least = least[labels]
    some = (links > 0) | (least != node) | (between & (not settled))
    columns = {c: tiles.column(c).filter(pa.array(some)) for c in ("length", "low", "high", "tile", "node")}
    return pa.table(columns | {"links": links[some], "other": pa.array(least[some], pa.int64(), mask=(least == node)[some]), "open": (between & (not settled))[some]})


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    An empty table gives an empty result; repeated rows are rows of their own. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths don't link. Equal vectors link, so copies count in ``n_links``. ``component_id`` is the least
    id reachable; null ids count as no id and are in it only where all are null.
    """
    marked = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    marked = marked.withColumn("node", F.when(usable(F.col("vector")), F.xxhash64("vector")))
    classes = marked.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("vector").alias("vector"))
    codes = materialize(quantised(classes))
    # one row for each length of vectors
    tiles = codes.groupBy("length").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = codes.drop("least", "vector").join(F.broadcast(tiles) if tiles.count() <= 100_000 else tiles, "length").withColumn("tile", F.pmod("node", F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("length", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "node", "copies", "code", "scale", "lost")
    found = materialize(dealt.groupBy("length", "low", "high").applyInArrow(lambda table: _group(table, threshold), _FOUND))
    pending = apart(found.where("open").select("length", "low", "high", "tile", "node"), "node").join(apart(codes.drop("length", "least"), "node"), ["node", "_apart"]).drop("_apart")
    exact = materialize(pending.groupBy("length", "low", "high").applyInArrow(lambda table: _group(table, threshold), _FOUND))
    both = found.unionByName(exact)
    links = both.groupBy("node").agg(F.sum("links").alias("links"))
    ties = both.where("other is not null").select("node", "other").distinct()
    roots = connected_components(ties, "node", "other")
    known = codes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = apart(known, "root").join(apart(least, "root"), ["root", "_apart"]).select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = materialize(known)
    plain = marked.select("id", "node")
    linked = apart(plain.where("node is not null"), "node").join(apart(known, "node"), ["node", "_apart"]).select("id", "n_links", "component_id")
    alone = plain.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
