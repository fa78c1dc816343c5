"""The registered queries over a small folder of tables: contract columns by brute force, SQL in DuckDB."""

from __future__ import annotations

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from swathlab.llm import language, quality, queries, sharding

from .conftest import awkward_rows
from .test_operators import luhn, reference_fingerprint, reference_spans, reference_targets, roots_of, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, embeddings, benchmark and labels; returns the folder and the documents' rows."""
    sf, rng = str(tmp_path_factory.mktemp("sf")), random.Random(17)
    rows = [(i, t, lang, s) for i, t, lang, s in awkward_rows() if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{sf}/documents.parquet")
    vectors = np.random.default_rng(3).normal(size=(60, 8))
    vectors[20:40] = vectors[:20] + np.random.default_rng(4).normal(scale=0.1, size=(20, 8))
    spark.createDataFrame([(i, list(map(float, v)), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    texts = {i: t for i, t, _, _ in rows}
    items = [(1, texts[3]), (2, " ".join(texts[91].split()[500:540])), (3, "none of these words is anywhere in them"), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 75, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def test_op1(spark, tables):
    sf, rows = tables
    found = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf).collect())
    prints = [(i, reference_fingerprint(t)) for i, t, _, _ in rows]
    distinct = sorted({p for _, p in prints})
    root = roots_of(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, p in prints:
        least[root[p]] = min(i, least.get(root[p], i))
    assert found == Counter((i, f"{p:016x}", least[root[p]]) for i, p in prints)


def test_op2(spark, tables):
    sf, rows = tables
    found = queries.op2_mixing(spark, sf).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    source = {i: s for i, _, _, s in rows}
    targets = reference_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, words(t)) for i, t, _, _ in rows)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s], abs_tol=1e-6) and r["taken"] <= 2 * r["size"]
        assert (r["slots"] > 0) == (r["first_slot"] is not None) == (r["taken"] > 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_op3(spark, tables):
    """Digest columns, and shards and slots recomputed from the splitters."""
    sf, rows = tables
    found = queries.op3_sharding(spark, sf).collect()
    given = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == given
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    keys = docs.select("doc_id", F.xxhash64("text").alias("key_high"), F.xxhash64("doc_id", F.lit("id")).alias("key_low"), size.alias("size"))
    splitters = sharding.find_splitters(keys.drop("doc_id"))
    wanted = Counter((k["doc_id"], bisect.bisect([(h, low, a - 1) for h, low, a in splitters], (k["key_high"], k["key_low"], -1))) for k in keys.collect())
    assert Counter((r["doc_id"], r["shard"]) for r in found) == wanted


def test_op4(spark, tables):
    sf, rows = tables
    found = {r["doc_id"]: r for r in queries.op4_spans(spark, sf).collect()}
    for i, t, _, _ in rows:
        r = found[i]
        cut = [tuple(map(int, x.split(":"))) for x in r["removed"].split(",") if x]
        assert r["kept_chars"] == len(t or "") - sum(b - a for a, b in cut) and 0 <= r["n_shared"] <= r["n_removed"] <= r["n_sentences"]


def test_op5(spark, tables):
    sf, rows = tables
    found = {r["doc_id"]: r for r in queries.op5_personal_data(spark, sf).collect()}
    assert luhn("4539148803436467")
    for i, t, _, _ in rows:
        base = [x for x in reference_spans(t).split(",") if x]
        given = [x for x in found[i]["spans"].split(",") if x]
        assert set(base) <= set(given) and found[i]["n_found"] == len(given) and found[i]["n_added"] == len(given) - len(base)


def test_op6(spark, tables):
    """Languages recomputed with plain dictionary compression."""
    sf, rows = tables
    found = {r["doc_id"]: r for r in queries.op6_language(spark, sf).collect()}
    given = language.fit_dictionaries(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    for i, t, _, _ in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= found[i]["score"] <= 1
        raw = re.sub(r"[\W\d_]+", " ", t or "").strip().lower().encode()
        if not any(map(str.isalpha, t or "")):
            assert found[i]["lang_pred"] == "und"
            continue
        sizes = {}
        for lang, content in given.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(press.compress(raw[k : k + language.PIECE_BYTES] + language.PADDING)) for k in range(0, len(raw), language.PIECE_BYTES))
        least = min(sizes.values())
        if sorted(sizes.values())[1] - least > 2:
            assert sizes[found[i]["lang_pred"]] == least


def test_op7(spark, tables):
    sf, rows = tables
    found = {r["doc_id"]: r for r in queries.op7_licenses(spark, sf).collect()}
    for i, t, _, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [k for phrase in ("cc by", "general public license", "all rights reserved") for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (found[i]["n_words"], found[i]["n_base"], found[i]["first_word"], found[i]["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_op10(spark, tables):
    """Priors and scores recomputed from the evidence: rates of sites, drawn to their parents."""
    sf, rows = tables
    found = queries.op10_quality(spark, sf).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    site = {i: (s, lang) for i, _, lang, s in rows}
    for target in quality.TARGETS:
        own = [(r["doc_id"], labels[r["doc_id"]][target] if r["doc_id"] in labels else 1 / (1 + math.exp(-r[f"{target}_evidence"]))) for r in found]
        sums = {level: defaultdict(lambda: [0, 0.0]) for level in (1, 2)}
        for i, p in own:
            for level in (1, 2):
                sums[level][site[i][:level]][0] += 1
                sums[level][site[i][:level]][1] += p
        rate = sum(p for _, p in own) / len(own)

        def strength(cells, rate=rate, n=len(own)):
            spread = sum(s * s / k for k, s in cells.values()) / n - rate * rate - len(cells) * rate * (1 - rate) / n
            return min(max(rate * (1 - rate) / max(spread, 1e-9) - 1, 1.0), 1000.0)

        one, two = strength(sums[1]), strength(sums[2])
        logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        for r, (i, p) in zip(found, own, strict=True):
            (n1, s1), (n2, s2) = sums[1][site[i][:1]], sums[2][site[i]]
            host = (s1 - p + one * rate) / (n1 - 1 + one)
            path = (s2 - p + two * host) / (n2 - 1 + two)
            assert math.isclose(r[f"{target}_prior"], path, rel_tol=1e-6)
            assert math.isclose(r[f"{target}_score"], 1 / (1 + math.exp(-(r[f"{target}_evidence"] + logit(path) - logit(rate)))), rel_tol=1e-6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tables, name):
    sf, _ = tables
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == names
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == sorted(str([r[k] for k in order]) for r in cursor.fetchall())
