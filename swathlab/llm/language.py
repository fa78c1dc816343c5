"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled from a bounded sample of
labelled texts. A text's letters, in lower case with single spaces between words, are cut
into pieces of ``PIECE_BYTES``; each piece is compressed with every dictionary, and the language
with the fewest bytes in total wins. Whole texts are compressed; cutting keeps
the dictionary's weight the same in long texts. Spaces are added to each piece, as the
compressor stores very short input as it is.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

#: Bound of the sample: bytes of text per language, and texts per language.
DICTIONARY_BYTES = 32 * 1024
SAMPLE_TEXTS = 256
PIECE_BYTES = 2048
PADDING = b" " * 64
LEVEL = 5
#: A text is rejected when the second-best language needs less than this share more bytes.
MARGIN = 0.01
#: Share of the saved bits that counts as evidence in the score.
SHARPNESS = 0.25
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text without digits and signs, in lower case, single spaces between."""
    return _OTHER.sub(" ", text.lower()).encode()


def held_out(id_col: str) -> Column:
    """True for documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from documents that aren't held out.

    The sample is up to ``SAMPLE_TEXTS`` texts of each language, first by hash of id and
    text, and up to ``DICTIONARY_BYTES`` in all (the last text is cut there). A threshold on the
    hash, from the language's count, leaves about 4 * ``SAMPLE_TEXTS`` rows to be ranked.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4.0 * SAMPLE_TEXTS / n))]), F.col("lang"))
    first = Window.partitionBy("lang").orderBy("place", "text")
    rows = (
        labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("place"))
        .where(F.shiftrightunsigned("place", 11) * F.lit(2.0**-53) <= share)
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= SAMPLE_TEXTS)
        .withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < DICTIONARY_BYTES)
        .select("lang", F.expr(f"substring(text, 1, {DICTIONARY_BYTES})").alias("text"), "n")
        .collect()
    )
    out: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        out[row["lang"]] = (out.get(row["lang"], b"") + letters(row["text"]) + b" ")[:DICTIONARY_BYTES]
    return out


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list:
    made = []
    for _, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return made


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, rejected) of a text.

    ``und``, score 0 and rejected: null, a text without a letter, or nothing learned. The score is the
    share of the best language when each one weighs exp(-bits): near 1 when the others
    need many more bits.
    """
    if text is None or not dictionaries or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    raw = letters(text)
    pieces = [raw[i : i + PIECE_BYTES] + PADDING for i in range(0, len(raw), PIECE_BYTES)]
    sizes = [sum(len(compress(piece)) for piece in pieces) for compress in _compressors(dictionaries)]
    best = min(range(len(sizes)), key=lambda i: (sizes[i], dictionaries[i][0]))
    score = 1 / sum(math.exp(-min(700.0, SHARPNESS * 8 * math.log(2) * (size - sizes[best]))) for size in sizes)
    second = min((size for i, size in enumerate(sizes) if i != best), default=None)
    return dictionaries[best][0], score, second is not None and second - sizes[best] < MARGIN * sizes[best]


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (names after ``prefix``).

    See ``classify`` for null, empty and letterless texts. Very long texts are encoded whole, piece by piece; of languages
    of equal size the first by code point is taken, and the document is rejected. Rows are independent, so repeated rows
    get equal results; an empty table gives an empty result. Columns of those names are replaced.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    kept = spread(docs).select(*[c for c in docs.columns if c not in names])
    given = tuple(sorted(dictionaries.items()))
    columns = kept.columns
    at = columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(text.as_py(), given) for text in batch.column(at)]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *names])

    return kept.mapInArrow(run, schema)
