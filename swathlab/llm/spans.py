"""Substring dedup by sliding spans of sentences.

A sentence ends behind its signs (also those of scripts without spaces between words) or with the line.
A span is a run of ``MIN_SENTENCES`` or more consecutive sentences with ``MIN_WORDS`` words or more; each sign of a script
without spaces counts as a word. Spans are compared by the 128-bit hash of their words, in lower case, over all documents.
Every sentence that a span other than the first of its kind covers is removed. The first is that of the least
document (id, nulls first, then row key), then the least place.

Of all the runs only the shortest from each sentence on and the shortest up to each sentence are hashed. That is the
same: a longer run that is repeated holds shorter ones that are repeated with it, from its beginning, and up to its end,
and they cover it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, drop_folder, materialize, row_key, spread, stored

MIN_SENTENCES = 2
MIN_WORDS = 16
#: Signs that end a sentence, and the white space that goes with it.
_ENDS = ".!?…。！？；؟۔।"
_SPACE = r"[\x20\x09-\x0D]"
_SENTENCE = re.compile(rf"(?:[^{_ENDS}\n]+(?:[{_ENDS}]+|\n|\Z)|[{_ENDS}]+|\n){_SPACE}*")
#: The same for Spark, with possessive repetition.
_SENTENCE_JAVA = rf"(?:[^{_ENDS}\n]++(?:[{_ENDS}]++|\n|\z)|[{_ENDS}]++|\n){_SPACE}*+"
#: Signs of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of the sentences, which cover the text without gaps."""
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def sentence_count(text: Column) -> Column:
    """The number of ``sentences`` as an expression."""
    return F.coalesce(F.regexp_count(text, F.lit(_SENTENCE_JAVA)), F.lit(0)).cast("int")


def shortest_runs(sizes: list[int], min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs from each sentence on and up to each sentence that are long enough, in order."""
    found, n = set(), len(sizes)
    end = words = 0
    for start in range(n):
        while end < n and (end - start < min_sentences or words < min_words):
            words += sizes[end]
            end += 1
        if end - start < min_sentences or words < min_words:
            break
        found.add((start, end - 1))
        words -= sizes[start]
    start, words = n, 0
    for end in range(n, 0, -1):
        while start > 0 and (end - start < min_sentences or words < min_words):
            start -= 1
            words += sizes[start]
        if end - start < min_sentences or words < min_words:
            break
        found.add((start, end - 1))
        words -= sizes[end - 1]
    return sorted(found)


def spans(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, last sentence) of the shortest spans from and up to each sentence of a text."""
    parts = [part.split() for part in _SENTENCE.findall((text or "").lower())]
    sizes = list(map(len, parts))
    if text and _UNSPACED.search(text):
        sizes = [max(n, len(_UNSPACED.findall("".join(p)))) for n, p in zip(sizes, parts, strict=True)]
    joined = [" ".join(part) for part in parts]
    return [(xxhash.xxh3_128_digest(" ".join(joined[a : b + 1]).encode()), a, b) for a, b in shortest_runs(sizes, min_sentences, min_words)]


def span_table(docs: DataFrame, id_col: str, text_col: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span: high, low (the hash), row_key, place (first sentence * 2**31 + last sentence)."""
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            for at, text in enumerate(batch.column(1)):
                for value, first, last in spans(text.as_py(), min_sentences, min_words):
                    rows.append(at)
                    hashes.append(value)
                    places.append(first << 31 | last)
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], names=["high", "low", "row_key", "place"]
            )

    return keyed.mapInArrow(run, "high bigint, low bigint, row_key bigint, place bigint")


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with repeats: row_key, covered (array of (first, last, elsewhere) sentences to remove).

    ``elsewhere``: the first of the kind is in another document. Only counts are aggregated over all spans; spans of one
    kind are then brought together by joins that adaptive execution can split for a passage that many documents share.
    """
    kind = ["high", "low"]
    found, folder = stored(span_table(spread(docs), id_col, text_col, min_sentences, min_words))
    counts = found.groupBy(*kind).agg(F.count("*").alias("n")).where("n > 1").select(*kind)
    # as ``apart`` does, by a column that takes hardly any room next to the hash
    sided = [rows.withColumn("_apart", F.shiftright("high", 63)) for rows in (found, counts)]
    shared = materialize(sided[0].join(sided[1], [*kind, "_apart"]).drop("_apart"))
    drop_folder(docs.sparkSession, folder)  # all spans, most of them in one place only
    ids = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id")).dropDuplicates(["row_key"])
    shared = apart(shared, "row_key").join(apart(ids, "row_key"), ["row_key", "_apart"]).select(*kind, "id", "row_key", "place")
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "row_key", "place")
    kinds = shared.groupBy(*kind).agg(F.min(order).alias("least"))
    again = apart(shared, *kind).join(apart(kinds, *kind), [*kind, "_apart"]).where(~((F.col("row_key") == F.col("least.row_key")) & (F.col("place") == F.col("least.place"))))
    again = again.select("row_key", F.shiftright("place", 31).cast("int").alias("first"), (F.col("place") % F.lit(1 << 31)).cast("int").alias("last"), (F.col("row_key") != F.col("least.row_key")).alias("elsewhere"))
    # a document's spans only, so an array of at most twice its sentences
    return again.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("first", "last", "elsewhere"))).alias("covered"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text's repeated sentences removed, and n_sentences, n_removed, n_shared, removed.

    ``removed``: start:end in code points of the removed parts of the original text, joined by commas; ``n_shared``: how
    many of the ``n_removed`` sentences another document has first (the others repeat what their own document has).
    Null texts stay null and empty ones empty, with no sentences; an empty table gives an empty result. Very long texts
    are cut whole. Repeated rows (equal id and text) count as one document and get the same result; copies under other
    ids lose all sentences that spans cover. Columns of those names are replaced.
    """
    names = ["n_sentences", "n_removed", "n_shared", "removed"]
    kept = docs.select(*[c for c in docs.columns if c not in names])
    repeats = repeated_sentences(kept, id_col, text_col, min_sentences, min_words)
    columns = kept.columns
    at = columns.index(text_col)
    packed = kept.select(row_key(id_col, text_col).alias("_key"), F.struct(*columns).alias("_doc"))
    joined = packed.join(repeats.withColumnRenamed("row_key", "_key"), "_key", "left").select(*[F.col("_doc")[c].alias(c) for c in columns], F.col("covered").alias("_covered"), sentence_count(F.col("_doc")[text_col]).alias("_sentences"))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names[:3]), T.StructField("removed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, shared, removed = [], [], [], []
            for value, covered in zip(batch.column(at), batch.column(len(columns)), strict=True):
                places = covered.as_py() or ()
                if not places:
                    texts.append(value)
                    gone.append(0)
                    shared.append(0)
                    removed.append("")
                    continue
                text = value.as_py()
                drop = {i for x in places for i in range(x["first"], x["last"] + 1)}
                parts = sentences(text)
                runs: list[list[int]] = []
                for i in sorted(drop):
                    if runs and runs[-1][1] == parts[i][0]:
                        runs[-1][1] = parts[i][1]
                    else:
                        runs.append(list(parts[i]))
                texts.append("".join(text[a:b] for i, (a, b) in enumerate(parts) if i not in drop))
                gone.append(len(drop))
                shared.append(len({i for x in places if x["elsewhere"] for i in range(x["first"], x["last"] + 1)}))
                removed.append(",".join(f"{a}:{b}" for a, b in runs))
            out = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in texts], pa.string()) if i == at and any(gone) else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, batch.column(len(columns) + 1), pa.array(gone, pa.int32()), pa.array(shared, pa.int32()), pa.array(removed, pa.string())], names=[*columns, *names])

    return joined.mapInArrow(run, schema)
