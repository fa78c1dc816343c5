"""Audit of how sources of a language differ in their words, on run-length columns.

A language's kept terms are ordered so that terms with equal counts stand together: by the number of sources that have
them, their total, and a hash of all their counts. In that order the counts of a source are a column with long runs
(zeros above all), which is run-length encoded. For two sources the runs' boundaries are intersected, and what they differ
by in a run is multiplied by its length, so that a pair costs its runs, not its terms.

The order is cut into blocks of terms and the sources into tiles; a task has one block of two tiles. Sums over blocks are
added by Spark. All arithmetic is on integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, materialize, partitions, spread

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in at least; ranks of the term part.
LEAST_DOCUMENTS = 30
TOP = 50
#: Added to every count; shares are counted in parts of this.
PRIOR, SCALE = 5, 1_000_000_000
#: Terms of a block, sources of a tile.
BLOCK, TILE = 4096, 32
#: Distinct terms that a task counts before it hands the counts on.
HELD = 200_000


def _handed_on(seen: dict[tuple[str, str], tuple[Counter[str], Counter[str]]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (times, docs) in seen.items():
        n = len(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in times], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )
    seen.clear()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Counts of the terms of each (lang, source): lang, source, term, n, docs; in parts, several rows may have the same key."""
    terms = re.compile(TERM)
    given = spread(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter[str], Counter[str]]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                times, docs = seen.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                own = Counter(terms.findall(text.as_py().encode().lower().decode()))  # bytes: only A to Z change
                held -= len(times)
                times.update(own)
                docs.update(own.keys())
                held += len(times)
                if held >= HELD:
                    yield from _handed_on(seen)
                    held = 0
        yield from _handed_on(seen)

    return given.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact for any counts."""
    wide = "decimal(20,0)"
    return F.lit(1) + F.call_function("div", (n + PRIOR).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (total + F.lit(PRIOR) * terms).cast(wide))


def kept_terms(counts: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Of ``term_counts``, whole counts of the terms kept: lang, source, term, n, total (n of all sources), first (one row per term has true), groups, mark.

    All sources of a term meet in one window, which Spark spills if they are many; they are at most as many as the sources.
    """
    term = Window.partitionBy("lang", "term")
    whole = counts.repartition(partitions(counts.sparkSession), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = whole.withColumns({
        "_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "groups": F.count("*").over(term), "mark": F.bit_xor(F.xxhash64("source", "n")).over(term), "_least": F.min("source").over(term),
    })
    return whole.where(F.col("_docs") >= least_documents).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("_least")).alias("first"), "groups", "mark")


def term_order(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """The order of the kept terms: lang, term, block, slot. Slots of a language in a block follow each other."""
    order = ["lang", "groups", "total", "mark", "term"]
    terms = kept.where("first").select(*order).repartitionByRange(partitions(kept.sparkSession), *order).sortWithinPartitions(*order)
    return terms.withColumn("slot", F.monotonically_increasing_id()).select("lang", "term", F.expr(f"slot div {block}").alias("block"), "slot")


def runs(first: int, length: int, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (from 0) and counts of the runs of a column of ``length`` slots from ``first`` on, in which the slots not given are zero."""
    column = np.zeros(length, np.int64)
    column[slots - first] = counts
    starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return starts, column[starts]


def run_difference(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of the absolute differences of two run-length columns: boundaries intersected, differences times lengths."""
    starts = np.union1d(left[0], right[0])
    (at, p), (bt, q) = left, right
    gap = np.abs(p[np.searchsorted(at, starts, "right") - 1] - q[np.searchsorted(bt, starts, "right") - 1])
    return int((gap * np.diff(np.append(starts, length))).sum())


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Differences of the sources of a tile's rows to those of another's (or of its own), in one block."""
    rows = table.to_pylist()
    columns: list[tuple[str, int, tuple[np.ndarray, np.ndarray]]] = []
    for r in rows:
        starts, counts = runs(r["low"], r["length"], np.array(r["slots"] or [], np.int64), np.array(r["counts"] or [], np.int64))
        below = r["size"] + PRIOR * r["terms"]
        columns.append((r["source"], r["tile"], (starts, np.array([1 + SCALE * (c + PRIOR) // below for c in counts.tolist()], np.int64))))
    one, two = rows[0]["one"], rows[0]["two"]
    out: list[tuple[str, str, int]] = []
    for i, (source, tile, column) in enumerate(columns):
        for other, other_tile, other_column in columns[i + 1 :]:
            if one == two or tile != other_tile:
                gap = run_difference(column, other_column, rows[0]["length"])
                out += [(source, other, gap), (other, source, gap)]
    return pa.table({"lang": pa.array([rows[0]["lang"]] * len(out), pa.string()), "source": pa.array([x[0] for x in out], pa.string()), "item": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})


def pair_values(groups: DataFrame, kept: DataFrame, order: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language that has kept terms. ``groups``: lang, source, size, terms."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-most // tile)
    cells = apart(kept, "lang", "term").join(apart(order, "lang", "term"), ["lang", "term", "_apart"])
    # at most as many entries as a block has terms
    cells = cells.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("cells"))
    cells = cells.select("lang", "block", "source", F.col("cells.slot").alias("slots"), F.col("cells.n").alias("counts"))
    blocks = order.groupBy("lang", "block").agg(F.min("slot").alias("low"), F.count("*").cast("int").alias("length"))
    every = apart(blocks, "lang").join(apart(groups, "lang"), ["lang", "_apart"]).drop("_apart").join(cells, ["lang", "block", "source"], "left")
    every = every.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    every = every.select("*", F.least("tile", "_other").alias("one"), F.greatest("tile", "_other").alias("two")).drop("_other")
    return every.groupBy("lang", "block", "one", "two").applyInArrow(_tile_pairs, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """How every source of a language differs from the others and from the language: lang, source, part, item, value, rank.

    Part ``pair``: item is each other source of the language, value the sum of the differences of their shares over all
    kept terms (0 without any). Part ``term``: items are the kept terms that the source has, and more of than the language,
    by how much more, the ``top`` first. Ranks go by value, descending, then item, ascending in UTF-8.
    Null texts, languages and sources are read as empty ones; repeated rows are documents like others; very long texts are
    read whole; an empty table gives an empty result. Other columns, whatever their names, aren't looked at.
    """
    known = materialize(docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct())
    kept = materialize(kept_terms(term_counts(docs, lang_col, source_col, text_col), least_documents))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = known.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "terms", "lang_size")]))
    order = materialize(term_order(kept, block))
    pairs = pair_values(groups.select("lang", "source", "size", "terms"), kept, order, block, tile)
    bare = apart(groups.where("terms = 0"), "lang")
    none = bare.select("lang", "_apart", "source").join(bare.select("lang", "_apart", F.col("source").alias("item")), ["lang", "_apart"]).where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.unionByName(none).withColumn("rank", F.row_number().over(ranked))
    shares = apart(kept, "lang", "source").join(apart(groups, "lang", "source"), ["lang", "source", "_apart"])
    gap = _share(F.col("n"), F.col("size"), F.col("terms")) - _share(F.col("total"), F.col("lang_size"), F.col("terms"))
    terms = shares.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
