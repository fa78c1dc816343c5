"""Benchmark decontamination: which documents hold most of a benchmark item's shingles.

Items are partitioned by size (powers of two of their distinct shingles), and each has a MinHash sketch, the least
hashes of its shingles, as many as the partition calls for. At a containment of ``threshold`` a document lacks at most
(1 - threshold) * n of an item's n shingles, so of a sketch of k it holds at least k - (1 - threshold) * n, however long the
document is. The sketches are twice as large as a single hit would need, so that a frequent shingle alone makes no
candidate. Documents aren't sketched: their shingles are looked up among the sketches' hashes, and what is met often enough
is verified by exact shingles. No contained item is missed.

The sketches' hashes are spread to the executors if they are ``BROADCAST_HASHES`` at most; more are joined by exchange.
Items' texts reach only the documents that meet their sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, materialize, row_key, spread

SHINGLE = 5
THRESHOLD = 0.8
#: Hashes of sketches (8 bytes each), and keys of documents, that are broadcast at most.
BROADCAST_HASHES = 2_000_000
BROADCAST_KEYS = 500_000
_PIECE = 1 << 20
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(0x20 if i in _SEPARATORS else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def fold(text: str | None) -> bytes:
    """The words of a text (digits, letters and what isn't ASCII; A-Z in lower case), single spaces between."""
    return b" ".join((text or "").encode().translate(_FOLD).split())


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, as many as were asked for so far."""

    up, down = _powers(_P, 2), _powers(_P_INVERSE, 2)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_P, n), _powers(_P_INVERSE, n)
        return cls.up, cls.down


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, starts, ends of the words) of a folded text."""
    raw = np.frombuffer(folded, np.uint8)
    up, down = _Powers.of(len(raw) + 1)
    gaps = np.flatnonzero(raw == 0x20)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def run_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """The hash of the shingle at each word, from the words' hashes."""
    n = max(0, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = out * _P + words[k : k + n]
    return _mixed(out)


def shingle_hashes(folded: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle at each word, starts, ends of the words) of a folded text."""
    words, starts, ends = word_hashes(folded)
    return run_hashes(words, shingle), starts, ends


def _pieces(folded: bytes, shingle: int) -> Iterator[bytes]:
    """A long text in parts that begin with the last ``shingle`` - 1 words of the one before, and have about ``_PIECE`` bytes (at least a word) more."""
    start = cut = 0
    while (cut := folded.find(b" ", cut + _PIECE)) >= 0:
        yield folded[start:cut]
        start = cut
        for _ in range(shingle - 1):
            start = folded.rfind(b" ", 0, start) if start > 0 else start
        start += 1
    yield folded[start:]


def _keyed(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hashes of shingles of that many words, so that other widths don't meet them."""
    return _mixed(hashes + np.uint64(width * int(_P) % (1 << 64)))


def sketch(text: str | None, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[int, int, int, np.ndarray]:
    """(width of the shingles, number of distinct ones, hits that a containing document has at least, sketch) of an item.

    An item of fewer words than a shingle has one shingle, all its words; one without words has none.
    """
    folded = fold(text)
    if not folded:
        return 0, 0, 0, np.zeros(0, np.uint64)
    width = min(shingle, folded.count(b" ") + 1)
    hashes = np.unique(_keyed(shingle_hashes(folded, width)[0], width))
    largest = (1 << len(hashes).bit_length()) - 1  # of its partition
    size = min(len(hashes), 2 * (math.floor((1 - threshold) * largest + 1e-9) + 1))
    return width, len(hashes), max(1, size - math.floor((1 - threshold) * len(hashes) + 1e-9)), hashes[:size]


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per hash of an item's sketch: item_key, width, needed, hash. Items equal in id and text are one."""
    keyed = items.select(row_key(id_col, text_col).alias("item_key"), F.col(text_col).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(text, shingle, threshold) for text in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(made)), [len(x[3]) for x in made])
            some = [np.array([x[k] for x in made], np.int64)[rows] for k in (0, 2)]
            hashes = np.concatenate([np.zeros(0, np.uint64), *(x[3] for x in made)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, some), pa.array(hashes)], names=["item_key", "width", "needed", "hash"])

    return keyed.mapInArrow(run, "item_key bigint, width bigint, needed bigint, hash bigint")


class Lookup:
    """Finds which of some hashes the shingles of texts have; without hashes, all of them."""

    def __init__(self, widths: list[int], hashes: np.ndarray | None):
        self.widths, self.known, self.maybe = widths, None if hashes is None else np.unique(hashes), None

    def _hits(self, folded: bytes, owners: list[int], counts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.known is not None and self.maybe is None:  # built where it is used, 16 bytes a hash at most
            self.maybe = np.zeros(1 << max(16, (8 * len(self.known)).bit_length()), bool)
            self.maybe[self.known & np.uint64(len(self.maybe) - 1)] = True
        words = word_hashes(folded)[0]
        last = np.cumsum(counts)
        for width in self.widths:
            hashes = _keyed(run_hashes(words, width), width)
            at = np.arange(len(hashes))
            if self.known is not None:
                at = np.flatnonzero(self.maybe[hashes & np.uint64(len(self.maybe) - 1)])
                at = at[self.known[np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)] == hashes[at]]
            first = np.searchsorted(last, at, "right")
            inside = first == np.searchsorted(last, at + width - 1, "right")
            yield np.array(owners, np.int64)[first[inside]], hashes[at[inside]]

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, hash), each pair once. Texts are looked up together, long ones in pieces."""
        found, parts, owners, counts, size = [], [], [], [], 0
        for at, text in enumerate(texts):
            folded = fold(text)
            for piece in _pieces(folded, max(self.widths)) if folded and self.widths else ():
                parts.append(piece)
                owners.append(at)
                counts.append(piece.count(b" ") + 1)
                size += len(piece)
                if size >= _PIECE:
                    found += self._hits(b" ".join(parts), owners, counts)
                    parts, owners, counts, size = [], [], [], 0
        if parts:
            found += self._hits(b" ".join(parts), owners, counts)
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *(o for o, _ in found)]), np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)]).view(np.int64)]), axis=1)
        return pairs[0], pairs[1]


def candidate_pairs(docs: DataFrame, sketches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item whose sketch it meets often enough: doc_key, item_key. ``sketches``: see ``item_sketches``."""
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect())  # at most as many as a shingle has words
    few = sketches.select("hash").distinct()
    held = few.count() <= BROADCAST_HASHES
    lookup = Lookup(widths, few.toPandas()["hash"].to_numpy(np.int64).view(np.uint64) if held else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = lookup.find(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes)], names=["doc_key", "hash"])

    # equal documents are one from here on
    hits = spread(docs).select(row_key(id_col, text_col).alias("doc_key"), F.col(text_col).alias("text")).mapInArrow(run, "doc_key bigint, hash bigint")
    met = hits.join(F.broadcast(sketches), "hash") if held else apart(hits, "hash").join(apart(sketches, "hash"), ["hash", "_apart"])
    return met.groupBy("doc_key", "item_key").agg(F.count_distinct("hash").alias("hits"), F.max("needed").alias("needed")).where("hits >= needed").select("doc_key", "item_key")


def _contained(text: str | None, items: list[dict], shingle: int, threshold: float) -> list[tuple[int, int, int]]:
    """(place in ``items``, the item's shingles, those that the text has too) of the items the text contains, compared word by word."""
    have: dict[int, set[bytes]] = {}
    words = fold(text).split()
    out = []
    for at, item in enumerate(items):
        own = fold(item["text"]).split()
        width = min(shingle, len(own))
        runs = {b" ".join(own[i : i + width]) for i in range(len(own) - width + 1)}
        if width not in have:
            have[width] = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
        shared = len(runs & have[width])
        if runs and shared >= threshold * len(runs) - 1e-9:
            out.append((at, len(runs), shared))
    return out


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item it contains: id_col, item_id, item_shingles, shared, containment.

    Null and empty texts contain nothing, and items without words are never found; very long texts are looked up whole. Repeated
    documents give a row each, repeated items count once. No items, or no documents, give no rows. Ids can be of any type.
    """
    sketches = materialize(item_sketches(items, item_col, "text", shingle, threshold))
    pairs = materialize(candidate_pairs(docs, sketches, id_col, text_col))
    given = items.select(row_key(item_col, "text").alias("item_key"), F.col(item_col).alias("item_id"), F.col("text")).dropDuplicates(["item_key"])
    # the items that a document meets: as many as its text has room for
    met = apart(pairs, "item_key").join(apart(given, "item_key"), ["item_key", "_apart"]).groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    keys = pairs.select("doc_key").distinct()
    chosen = docs.select(row_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if keys.count() <= BROADCAST_KEYS:
        chosen = chosen.join(F.broadcast(keys), "doc_key", "left_semi")
    both = chosen.join(met, "doc_key").select("id", "text", "items")
    kinds = {name: both.select(column).schema[0].dataType for name, column in ((id_col, "id"), ("item_id", F.explode("items.item_id")))}
    schema = T.StructType([*(T.StructField(n, t) for n, t in kinds.items()), T.StructField("item_shingles", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, sizes, shared = [], [], [], []
            lists = batch.column(2)
            for at, text in enumerate(batch.column(1)):
                for i, n, k in _contained(text.as_py(), lists[at].as_py(), shingle, threshold):
                    rows.append(at)
                    places.append(lists.offsets[at].as_py() + i)
                    sizes.append(n)
                    shared.append(k)
            item_ids = lists.values.field("item_id").take(pa.array(places, pa.int64()))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), item_ids, pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([k / n for k, n in zip(shared, sizes, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return both.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item; columns are those of ``docs``. Null and empty texts stay, and all documents without
    items; an empty table gives an empty result; repeated documents stay or go together."""
    keyed = docs.select(row_key(id_col, text_col).alias("_key"), F.struct(*docs.columns).alias("_doc"))
    found = contaminated_pairs(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("d")).select(row_key("d.id", "d.text").alias("key"), "d.text"), items, "key", "text", item_col, shingle, threshold)
    bad = materialize(found.select(F.col("key").alias("_key")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return keyed.join(bad, "_key", "left_anti").select("_doc.*")
