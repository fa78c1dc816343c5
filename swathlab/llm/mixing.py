"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in hash order, form a stream of words that is cut into blocks
of ``block_words``. Slot n of the mix has the point frac((n + 1/2) * golden ratio);
the point falls in one source's part of the cumulative weights. Slots are dealt until every source has as many as its
target has blocks (further ones of a source that has them aren't used). The k-th slot of a
source takes the k-th block of its stream, which wraps around once the source is used up. What the mix takes, and in
which order, is what its slots take.

DataFrame operations only. Positions and ranks are counted in two steps (within hash
buckets or runs of slots, then over them), so that no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: The golden ratio's fraction, and the fraction of 2**20 times it, so that points of
#: slots beyond 2**33 keep their precision.
GOLDEN = 0.6180339887498949
GOLDEN_20 = (1 << 20) * GOLDEN % 1.0
BLOCK_WORDS = 512
ROWS_PER_BUCKET = 2048
#: Beyond this the points don't spread; the golden ratio's do, so it is never met.
MAX_SLOTS = 1 << 46
WEIGHTS = (5.0, 2.0, 1.0)


def cycled_weights(rank: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weight of the source of that rank (from 0), the list repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))


def source_targets(sized: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target.

    ``share`` times all sizes is shared by weight; a target stops at ``most`` times its
    source's size and the excess is shared again by weight. The fixed point of that is
    min(cap, weight * level): sources are ordered by cap / weight, and the level is that
    at which the next one isn't capped. Sources are ordered by code point, null last.
    One row per source goes through a window; rows of documents don't.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", cycled_weights(F.col("rank"), weights))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
    )
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)
    target = F.when(free.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * free["level"]))
    return per.select("source", "source_size", "rank", "weight", target.alias("target"))


def _with_offsets(rows: DataFrame, key: str, cell: str, amount: Column, order: list, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows of the same key before each row.

    Rows are summed within cells (key, cell), then cells over the key.
    """
    cells = rows.groupBy(key, cell).agg(F.sum(amount).alias("_cell"))
    before = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, cell, F.coalesce(F.sum("_cell").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(cells, [key, cell]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _hits(quotas: DataFrame, slots: DataFrame) -> DataFrame:
    """The source of each slot: slot, rank, blocks. ``cells``: the number of equal cells of [0, 1) by which slots find their source."""
    parts = quotas.where("blocks > 0").select(
        "rank", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * F.col("cells")), F.floor(F.col("high") * F.col("cells")))).alias("cell")
    )
    n = F.col("slot")
    point = F.pmod(F.floor(n / F.lit(1 << 20)) * F.lit(GOLDEN_20) + (n % F.lit(1 << 20)) * F.lit(GOLDEN) + F.lit(GOLDEN / 2), F.lit(1.0))
    placed = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * F.col("cells"))).drop("cells")
    return placed.join(parts, "cell").where("point >= low and point < high").select("slot", "rank", "blocks")


def schedule_slots(quotas: DataFrame) -> DataFrame:
    """One row per slot that is used: slot, rank, block.

    ``quotas``: rank, blocks, low, high (the source's part of [0, 1)), cells. A slot's place among its
    source's slots is its block. A source's points come at most a few blocks late, so the slots are as many as the
    blocks, and then as many more as the sources that still lack some call for; only counts per source are looked at.
    """
    spark = quotas.sparkSession
    last = slots = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    cells = (quotas.agg(F.max("cells")).first()[0] or 64) if slots else 64
    table = lambda n: spark.range(n).select(F.col("id").alias("slot"), F.lit(cells).alias("cells"))
    while last:
        had = _hits(quotas, table(slots)).groupBy("rank").agg(F.count("*").alias("had"))
        short = quotas.where("blocks > 0").join(had, "rank", "left").withColumn("lacks", F.col("blocks") - F.coalesce("had", F.lit(0))).where("lacks > 0")
        last = short.agg(F.max(F.ceil((F.col("lacks") + 1) / (F.col("high") - F.col("low"))))).first()[0]
        slots += last or 0
        if slots > MAX_SLOTS:
            raise RuntimeError(f"the schedule gives some source no slots: {slots}")
    hits = _hits(quotas, table(slots)).withColumn("run", F.floor(F.col("slot") / F.lit(ROWS_PER_BUCKET)))
    return _with_offsets(hits, "rank", "run", F.lit(1), ["slot"], "block").where("block < blocks").select("slot", "rank", "block")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """The documents with their targets, and the pieces of them that the mix takes.

    Documents: row_key, copy, id, source, size, source_size, target, start (place in the
    source's stream); one row per input row. Pieces: slot, rank, block, row_key, copy, pass (of the stream),
    start, words, size; a document is cut where a block ends.

    Null and empty texts have size 0 and are in no piece. A null source is a source.
    Rows equal in id, text and source share a row_key and are told apart by ``copy``. An empty
    table gives two empty results.
    """
    sized = materialize(
        docs.select(F.xxhash64(id_col, text_col, source_col).alias("row_key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    )
    spark = docs.sparkSession
    targets = materialize(source_targets(sized, share, most, weights).withColumn("take", F.least(F.round("target").cast("long"), F.floor(F.lit(most) * F.col("source_size")))))
    buckets = max(1, sized.count() // ROWS_PER_BUCKET)

    placed = sized.withColumn("same", F.xxhash64("source"))
    inputs = placed.withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)))
    streamed = _with_offsets(inputs, "same", "bucket", F.col("size"), ["row_key", "size"], "start")
    copies = Window.partitionBy("same", "bucket").orderBy("row_key", "size", "start")
    streamed = streamed.withColumn("copy", F.row_number().over(copies))
    info = targets.select(F.col("source").alias("_source"), "source_size", "target", "take", F.col("rank").alias("source_rank"))
    streamed = materialize(
        streamed.join(F.broadcast(info) if targets.count() <= 10_000 else info, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "same", "bucket")
    )

    passes = F.explode(F.array(*[F.lit(p) for p in range(int(-(-most // 1)))]))
    pieces = (
        streamed.where("size > 0")
        .withColumn("pass", passes)
        .withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
        .where("from < take")
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))))
        .select(
            F.col("source_rank").alias("rank"), "block", "row_key", "copy", "pass", "size",
            (F.greatest("from", F.col("block") * block_words) - F.col("from")).alias("start"),
            (F.least("to", (F.col("block") + 1) * block_words) - F.greatest("from", F.col("block") * block_words)).alias("words"),
        )
    )

    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    quotas = targets.select("rank", F.ceil(F.col("take") / block_words).alias("blocks"))
    quotas = (
        quotas.withColumn("sum", F.sum("blocks").over(whole)).withColumn("upto", F.sum("blocks").over(upto))
        .withColumn("low", (F.col("upto") - F.col("blocks")) / F.greatest("sum", F.lit(1))).withColumn("high", F.col("upto") / F.greatest("sum", F.lit(1)))
        .withColumn("cells", F.greatest(F.lit(64), 4 * F.count("*").over(whole)))
    )
    return streamed, schedule_slots(materialize(quotas)).join(pieces, ["rank", "block"])


def taken_words(streamed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents of ``mix_sources`` with what their slots take: ``taken`` (words, repeats counted), ``slots`` (their number), ``first_slot``."""
    taken = pieces.groupBy("row_key", "copy").agg(F.sum("words").alias("taken"), F.count("*").alias("slots"), F.min("slot").alias("first_slot"))
    joined = streamed.join(taken, ["row_key", "copy"], "left")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("slots", F.coalesce("slots", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix in the order of their slots, each as often as it is taken.

    A document stands where its first block of a pass has its slot. Only where a source's stream ends is a document taken in
    part; it is whole in the result if at least half of it is taken. Documents without words are in no piece and thus not in
    the result. Rows equal in id, text and source share their number evenly, the
    remainder to the first, at the first of their slots. An empty table gives an empty result. Columns are those of ``docs``.
    """
    _, pieces = mix_sources(docs, id_col, text_col, source_col, **options)
    passes = pieces.groupBy("row_key", "copy", "pass").agg(F.sum("words").alias("words"), F.max("size").alias("size"), F.min("slot").alias("slot")).where("2 * words >= size")
    passes = materialize(passes)
    keyed = docs.select(F.xxhash64(id_col, text_col, source_col).alias("row_key"), F.struct(*docs.columns).alias("doc"))
    # repeated rows are told by their number in the stream; all others need no rank among rows
    repeated = keyed.select("row_key").groupBy("row_key").agg(F.count("*").alias("rows"))
    taken = passes.select("row_key", "slot").join(repeated, "row_key")
    single = keyed.join(taken.where("rows = 1").drop("rows"), "row_key").select("slot", "doc")
    shared = taken.where("rows > 1").groupBy("row_key").agg(F.count("*").alias("times"), F.min("slot").alias("slot"), F.max("rows").alias("rows"))
    n = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    several = keyed.join(shared, "row_key").withColumn("n", n).withColumn("times", F.floor(F.col("times") / F.col("rows")) + (F.col("n") <= F.col("times") % F.col("rows")).cast("int"))
    several = several.where("times > 0").select("slot", "doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("n")).drop("n")
    return single.unionByName(several).orderBy("slot").select("doc.*")
