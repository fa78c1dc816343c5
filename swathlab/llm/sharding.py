"""Sharding by histogram sort: shards of near-equal bytes over a total order of keys.

A row's key is two 64-bit hashes, of its text and of its id, so that equal texts are
neighbours and a group of copies larger than a shard can still be cut. Each round counts
the exact rows and bytes below candidate boundaries (8 more bits of the key around
every splitter that isn't settled yet); a splitter settles once a boundary is within the
tolerance of its share, or its range holds a single key. Rows are exchanged once, after that.
The driver sees at most (shards - 1) * 256 counts a round, whatever the input.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
BITS = 8
TOLERANCE = 0.001
ROWS_PER_CELL = 2048
KEY_BITS = 128


def _prefix(level: int) -> list[Column]:
    """The first ``level`` * 8 bits of the key as two longs (high part, low part)."""
    bits = level * BITS
    high = F.shiftright("key_high", 64 - bits) if 0 < bits < 64 else (F.col("key_high") if bits else F.lit(0).cast("long"))
    low = F.shiftright("key_low", 128 - bits) if 64 < bits < 128 else (F.col("key_low") if bits == 128 else F.lit(0).cast("long"))
    return [high, low]


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """The first keys of shards 1 to ``shards`` - 1, in order.

    ``keys``: key_high, key_low, size. Shard i is to start where i / ``shards`` of all
    bytes lie below. A key is never cut. An empty table needs no splitters and gets none.
    A splitter is (high, low, 1 if it lies just after that key, else 0).
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return []
    goals = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    #: prefix of a range that holds unsettled splitters -> bytes below it
    ranges, level = {(0, 0): 0}, 0
    found: dict[int, tuple[int, int, int]] = {}
    inside = {i: (0, 0) for i in goals}
    while inside:
        level += 1
        here, there = _prefix(level - 1), _prefix(level)
        chosen = functools.reduce(Column.__or__, [(here[0] == h) & (here[1] == w) for h, w in ranges])
        counts = (
            keys.where(chosen)
            .groupBy(here[0].alias("h"), here[1].alias("l"), there[0].alias("high"), there[1].alias("low"))
            .agg(F.sum("size").alias("bytes"), F.min(F.struct("key_high", "key_low")).alias("first"), F.max(F.struct("key_high", "key_low")).alias("last"))
            .orderBy("high", "low")
            .collect()
        )
        following: dict[tuple[int, int], int] = {}
        left: dict[int, tuple[int, int]] = {}
        for i, at in inside.items():
            below = ranges[at]
            for row in (r for r in counts if (r["h"], r["l"]) == at):  # noqa: B007
                if below + row["bytes"] > goals[i]:
                    break
                below += row["bytes"]
            end = below + row["bytes"]
            off = min(goals[i] - below, end - goals[i])
            if off <= slack or row["first"] == row["last"] or level * BITS >= KEY_BITS:
                found[i] = (*row["last"], 1) if end - goals[i] < goals[i] - below else (*row["first"], 0)
            else:
                left[i] = (row["high"], row["low"])
                following[left[i]] = below
        inside, ranges = left, following
    return [found[i] for i in sorted(found)]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. The shards' bytes are
    equal up to the tolerance and one key. Equal texts are neighbours, so a group of copies
    is cut only where a splitter falls into it. Rows equal in id and text share a key and
    thus a shard. An empty table gives an empty result. Columns of those names in ``docs``
    are replaced.

    Slots follow cells of about ``ROWS_PER_CELL`` rows of a shard, then the key. The one exchange
    of whole rows is by (shard, cell): a shard's rows never need one task.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).cast("long")
    key = F.struct(F.xxhash64(text_col).alias("key_high"), F.xxhash64(id_col, F.lit("id")).alias("key_low"), size.alias("size"))
    keys = materialize(docs.select(key.alias("key")).select("key.*"))
    splitters = find_splitters(keys, shards, tolerance)
    cells = max(1, keys.count() // (shards * ROWS_PER_CELL))

    def dealt(rows: DataFrame) -> DataFrame:
        here, shard = F.struct("key_high", "key_low"), F.lit(0)
        for high, low, after in splitters:
            bound = F.struct(F.lit(high).cast("long").alias("key_high"), F.lit(low).cast("long").alias("key_low"))
            shard = shard + (here > bound if after else here >= bound).cast("int")
        return rows.withColumn("shard", shard).withColumn("_cell", F.pmod("key_low", F.lit(cells)))

    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt(keys).groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    offsets = offsets.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("key_high", "key_low"))
    rows = dealt(docs.select(*[F.col(c).alias(f"_doc_{c}") for c in kept], key.alias("key")).select("*", "key.key_high", "key.key_low").drop("key"))
    rows = rows.withColumn("_place", place).join(offsets, ["shard", "_cell"])
    return rows.select(*[F.col(f"_doc_{c}").alias(c) for c in kept], "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"))
