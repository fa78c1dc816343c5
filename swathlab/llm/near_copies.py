"""Near copies by SimHash at a similarity of five-word shingles, beyond what one short fingerprint can tell.

The similarity of two documents is the cosine of their sets of shingles, common / sqrt(a * b), which is what
SimHash measures: the share of fingerprint bits that differ is the angle between the sets. For sets of like size a
cosine of 0.8 is a Jaccard similarity of 2/3, so every pair with a Jaccard similarity of 0.8 is in.

A document has two sets of 64-bit fingerprints. Those of its distinct words change least in a near copy
and find candidates: two documents meet if they share a covering mask's bucket in any of the
fingerprints, which all pairs do whose words' fingerprints differ in ``RADIUS`` bits or fewer in one of them. Those of its distinct
shingles decide: documents that meet are linked if no more bits differ than stand for the similarity, and ``ERRORS`` standard
errors. With 1,536 bits the error of a cosine of 0.8 is about 0.019.

Documents with equal sets of shingles are one from the start. Buckets of up to ``PAIRED`` members are compared pair by pair,
larger ones in tiles that return each row's tie to the least signature in its reach. The rule is the same in both, and
links don't grow with the square of a group; a hot bucket's rows go to as many tiles as it has, one for each ``TILE_ROWS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, partitions, row_key, spread
from .components import connected_components
from .decontamination import _mixed, fold, run_hashes, shingle_hashes, word_hashes
from .simhash import _signed, covering_masks
from .vectors import _forest

#: Fingerprints of the words (to meet) and of the shingles (to decide).
WORD_PRINTS, SHINGLE_PRINTS = 8, 24
RADIUS = 3
SHINGLE = 5
SIMILARITY = 0.8
#: Standard errors of the estimate by which a linked pair may be below the similarity, so that few pairs at it are lost.
ERRORS = 1.0
#: The same for the first fingerprints alone, which only rule strangers out.
CHECK_ERRORS = 4.0
#: Shingle fingerprints that go into the buckets; they tell strangers apart before pairs are joined to the others.
CHECKS = 2
#: Keys of buckets with several members that are broadcast at most; more are joined by exchange.
BROADCAST_KEYS = 500_000
PAIRED = 4
TILE_ROWS = 4096
_BLOCK = 256
#: Rows of bits that are counted in one byte.
_CHUNK = 255
_TURNS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(max(WORD_PRINTS, SHINGLE_PRINTS))], np.uint64)


def most_bits(similarity: float = SIMILARITY, errors: float = 0.0, bits: int = 64 * SHINGLE_PRINTS) -> int:
    """The number of differing bits that stands for the similarity, and some standard errors more."""
    share = math.acos(similarity) / math.pi
    return math.floor(bits * share + errors * math.sqrt(bits * share * (1 - share)))


def prints(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` fingerprints of a set of hashes: majority bits of the hashes turned by as many factors."""
    counts = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        turned = _mixed(hashes[at : at + _CHUNK, None] * _TURNS[None, :n])
        counts += np.add.reduce(np.unpackbits(turned.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def plain_words(text: str | None) -> bytes:
    """The words of a text without ASCII signs and capitals, or with the signs if it has no others; single spaces between."""
    return fold(text) or b" ".join((text or "").encode().lower().split())


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order; of all its words if they are fewer."""
    words = plain_words(text)
    return np.unique(shingle_hashes(words, min(shingle, words.count(b" ") + 1))[0]) if words else np.zeros(0, np.uint64)


def describe(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """(signature of the set of shingles, word fingerprints and shingle fingerprints) of a text; zeros without words."""
    words = plain_words(text)
    if not words:
        return 0, np.zeros(WORD_PRINTS + SHINGLE_PRINTS, np.int64)
    hashes = word_hashes(words)[0]
    runs, distinct = np.unique(run_hashes(hashes, min(shingle, len(hashes)))), np.unique(hashes)
    signature = np.add.reduce(_mixed(runs ^ np.uint64(0xD6E8FEB86659FD93)))
    return int(signature.view(np.int64)) or 1, np.concatenate([prints(distinct, WORD_PRINTS), prints(runs, SHINGLE_PRINTS)])


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, row_key, sig, prints (those of words, then those of shingles)."""
    kept = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(text.as_py(), shingle) for text in batch.column(2)]
            flat = np.concatenate([np.zeros(0, np.int64), *(p for _, p in found)])
            arrays = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, WORD_PRINTS + SHINGLE_PRINTS), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.int64()), arrays], names=["id", "row_key", "sig", "prints"])

    return kept.mapInArrow(run, f"id {kind}, row_key bigint, sig bigint, prints array<bigint>")


def _tile(rows: pa.Table, most: int, check: int) -> pa.Table:
    """Ties (left, right) of two tiles of a bucket (or of one): each row to the least signature that it reaches by pairs
    of both tiles that differ in up to ``most`` bits, and in up to ``check`` bits of the first ``CHECKS`` fingerprints. Rows meet in many buckets; tied to the least, they are mostly tied
    alike, so few different ties are left.
    """
    words = rows.column("prints").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.uint64)
    tile, sig = rows.column("tile").to_numpy(), rows.column("sig").to_numpy()
    first = np.flatnonzero(tile == rows.column("low")[0].as_py())
    second = np.flatnonzero(tile == rows.column("high")[0].as_py())
    labels = np.arange(rows.num_rows)
    for at in range(0, len(first), _BLOCK):
        block = first[at : at + _BLOCK]
        apart_by = np.zeros((len(block), len(second)), np.uint16)
        strangers = False
        for k in range(words.shape[1]):
            apart_by += np.bitwise_count(words[block, k][:, None] ^ words[second, k][None, :])
            if k == CHECKS - 1:
                strangers = apart_by > check
        i, j = np.nonzero((apart_by <= most) & ~strangers)
        _forest(labels, block[i], second[j])
    least = sig.copy()
    np.minimum.at(least, labels, sig)
    least = least[labels]
    tied = np.flatnonzero(least != sig)
    return pa.table({"left": least[tied], "right": sig[tied]})


def _differ(left: str, right: str, n: int) -> Column:
    """The number of bits in which ``n`` fingerprints differ."""
    return sum((F.bit_count(F.element_at(left, k).bitwiseXOR(F.element_at(right, k))) for k in range(1, n + 1)), F.lit(0))


def similar_links(classes: DataFrame, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (left, right) that tie similar signatures; ``classes``: sig, prints, one row per signature."""
    masks = covering_masks(RADIUS)
    slots = F.array(*[F.xxhash64(F.lit(k * len(masks) + i), F.element_at("prints", k + 1).bitwiseAND(F.lit(_signed(m)))) for k in range(WORD_PRINTS) for i, m in enumerate(masks)])
    keyed = classes.select("sig", F.explode(slots).alias("slot"))
    filled = materialize(keyed.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1"))
    if filled.count() <= BROADCAST_KEYS:
        shared = keyed.join(F.broadcast(filled), "slot").select("slot", "n", "sig")
    else:
        shared = apart(keyed, "slot").join(apart(filled, "slot"), ["slot", "_apart"]).select("slot", "n", "sig")
    shared = materialize(shared.repartition(partitions(classes.sparkSession), "sig"))
    most, check = most_bits(similarity, ERRORS), most_bits(similarity, CHECK_ERRORS, 64 * CHECKS)
    own = F.slice("prints", WORD_PRINTS + 1, SHINGLE_PRINTS)

    checks = classes.select("sig", F.slice(own, 1, CHECKS).alias("check"))
    few = apart(shared.where(F.col("n") <= PAIRED), "sig").join(apart(checks, "sig"), ["sig", "_apart"])
    members = few.groupBy("slot").agg(F.collect_list(F.struct("sig", "check")).alias("members"))
    pairs = members.select("members", F.explode("members").alias("a")).select("a", F.explode("members").alias("b")).where("a.sig < b.sig")
    met = pairs.where(_differ("a.check", "b.check", CHECKS) <= check).select(F.col("a.sig").alias("left"), F.col("b.sig").alias("right")).distinct()
    for end in ("left", "right"):
        met = apart(met, end).join(apart(classes.select(F.col("sig").alias(end), own.alias(f"{end}_prints")), end), [end, "_apart"]).drop("_apart")
    linked = met.where(_differ("left_prints", "right_prints", SHINGLE_PRINTS) <= most).select("left", "right")

    known = apart(shared.where(F.col("n") > PAIRED), "sig").join(apart(classes.select("sig", own.alias("prints")), "sig"), ["sig", "_apart"])
    dealt = known.withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")).withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = dealt.select("slot", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "sig", "prints")
    ties = tiled.groupBy("slot", "low", "high").applyInArrow(lambda rows: _tile(rows, most, check), "left bigint, right bigint")
    return linked.unionByName(ties).distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, row_key, sig, root. Equal roots are a group of copies and near copies.

    Null texts and those without words have the signature 0 and are copies of each other. Very long texts are read whole.
    Repeated rows are rows of their own. An empty table gives an empty result.
    """
    marked = materialize(described(spread(docs), id_col, text_col, shingle))
    classes = marked.where("sig <> 0").groupBy("sig").agg(F.first("prints").alias("prints"))
    classes = materialize(classes.repartition(partitions(docs.sparkSession), "sig"))  # every row of it makes many
    roots = connected_components(similar_links(classes, similarity), "left", "right").withColumnRenamed("node", "sig")
    joined = apart(marked.drop("prints"), "sig").join(apart(roots, "sig"), ["sig", "_apart"], "left")
    return joined.select("id", "row_key", "sig", F.coalesce("root", "sig").alias("root"))


def deduplicate_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group left: that with the least id (nulls last), then the least key.

    Repeated rows (equal id and text) count as one. Columns are those of ``docs``.
    """
    marked = similar_components(docs, id_col, text_col, shingle, similarity)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    chosen = marked.groupBy("root").agg(F.min(best).alias("best")).select(F.col("best.id").alias("_id"), F.col("best.row_key").alias("_key"))
    packed = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_doc"))
    same = (packed["_key"] == chosen["_key"]) & packed["_id"].eqNullSafe(chosen["_id"])
    return packed.join(chosen, same, "left_semi").dropDuplicates(["_key", "_id"]).select("_doc.*")
