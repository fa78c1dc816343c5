"""Spelling variants: words one edit apart, found by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point makes one the other. The shorter word (either, if they
are as long) is cut into two disjoint chunks, its halves. One edit leaves one of the two whole, and in the other word that
half stands at its place, or one place on if the edit is an insertion before it. So the other word contributes its
positional grams of the halves' sizes at those shifts (of all its positional grams only those within shift one of a
chunk's place can join, and the two lengths say which shift it is), and words that share chunk and gram are verified.

A bucket of more than ``PAIRED`` words isn't paired. What the chunk leaves of its words differs by the one edit, so it is
cut into halves again, and so on, until buckets are small or a single code point is left. Every pair is met once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, spread

#: Words are runs of these letters; the number of code points that a counted word has at least.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a word's form if it occurs this many times as often.
RATIO = 10
#: Of the runs whose checksum this divides, one code point is left out.
THINNED = 31
#: Words of a bucket that are paired; larger ones are cut further.
PAIRED = 64
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000
_ROUNDS = 40


def _handed_on(seen: Counter[str]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
    seen.clear()
    return batch


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, thinned: int | None = THINNED) -> DataFrame:
    """One row per distinct word of the texts: word, n.

    Words are maximal runs of ``LETTERS``, A to Z in lower case. If ``thinned`` divides the CRC-32 of ``<id>:<word>``, the
    code point at that checksum modulo the word's length is left out (a null id is written as nothing). Words of less than
    ``least_length`` code points after that aren't counted. Null and empty texts have none; very long ones are read whole;
    repeated rows count as often as they occur.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")
    given = spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                before = zlib.crc32(key.as_py().encode() + b":")
                for word, n in Counter(runs.findall(text.as_py().encode().lower().decode())).items():  # bytes: only A to Z change
                    if thinned:
                        check = zlib.crc32(word.encode(), before)
                        if check % thinned == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    seen[word] += n
                if len(seen) >= HELD:
                    yield _handed_on(seen)
        yield _handed_on(seen)

    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows' rests (``rest``; ``longer``: 1 if the word is to be the longer one) by chunk: the first half with what follows it as
    the new rest, and the second half with what is before it."""
    half = ((F.length("rest") - F.col("longer")) / 2).cast("int")
    tail = half + F.col("longer")  # where the second half stands, if the edit is an insertion before it
    size = F.length("rest")
    head = F.struct(F.xxhash64("key", F.lit(0), half, F.left("rest", half)).alias("key"), F.substr("rest", half + 1, size).alias("rest"), F.col("behind").alias("behind"))
    last = F.struct(F.xxhash64("key", F.lit(1), half, F.substr("rest", tail + 1, size)).alias("key"), F.left("rest", tail).alias("rest"), F.lit(True).alias("behind"))
    return rows.select("word", "n", "longer", F.explode(F.array(head, last)).alias("_cut")).select("word", "n", "longer", "_cut.*")


def _met(rows: DataFrame) -> DataFrame:
    """The near pairs in the rows' buckets. A pair that meets at a second half is left to the first halves if those are equal too."""
    left = rows.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
    right = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"), "longer", "behind")
    twice = F.col("behind") & F.col("b_rest").startswith(F.col("a_rest"))
    pairs = left.join(right, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & ~twice)
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Every pair of near words once: a, a_n, b, b_n. ``words``: word (distinct, not null), n.

    An empty table gives none. Words of any length are compared, the empty one and single letters too.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.select("word", "n", sides).select("word", "n", "longer", (F.length("word") - F.col("longer")).cast("long").alias("key"), F.col("word").alias("rest"), F.lit(False).alias("behind")).where("key >= 0")
    found = []
    for _ in range(_ROUNDS):
        rows = _cut(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("_all"), F.min("longer").alias("_least"), F.max(F.length("rest") - F.col("longer")).alias("_rest")).where("_all > 1 and _least = 0")
        rows = materialize(apart(rows, "key").join(apart(sizes, "key"), ["key", "_apart"]).drop("_apart", "_least"))
        # behind a chunk a single code point, or two, is all that is left of a word: there are only so many of them
        few = (F.col("_all") <= paired) | (F.col("_rest") <= 1)
        found.append(_met(rows.where(few)))
        rows = rows.where(~few).drop("_all", "_rest")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _one(word: str, n: str, other: str, other_n: str) -> Column:
    return F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(other).alias("other"), F.col(other_n).alias("other_n"))


def spelling_forms(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, paired: int = PAIRED) -> DataFrame:
    """One row per word of ``counts`` (word, n) with ``least_count`` or more occurrences: word, form, root, n, n_near, form_n.

    ``form``: its near word of largest n, of those the smallest in code-point order, if that n is ``ratio`` times the word's
    or more; else null, as is ``form_n``. ``root``: where the forms lead to, the word itself if it has none. Counts grow
    from form to form, so there are no rings. An empty table gives an empty result.
    """
    words = materialize(counts.where((F.col("n") >= least_count) & F.col("word").isNotNull()).select("word", "n"))
    both = near_pairs(words, paired).select(F.explode(F.array(_one("a", "a_n", "b", "b_n"), _one("b", "b_n", "a", "a_n"))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    named = materialize(named)
    roots = materialize(named.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # n grows by the ratio with each step, and steps double: five rounds at most for 64-bit counts and a ratio of 10
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = apart(roots, "root").join(apart(onward, "root"), ["root", "_apart"], "left").drop("_apart")
        if joined.where("_next is not null").isEmpty():
            break
        roots = materialize(joined.select("word", F.coalesce("_next", "root").alias("root")))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_forms`` of the words of the texts (see ``word_counts``). Other columns, whatever their names, aren't looked at."""
    return spelling_forms(word_counts(docs, id_col, text_col))
