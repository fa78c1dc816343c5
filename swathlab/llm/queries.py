"""The queries of this subpackage over the given tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, language, licenses, mixing, pages, pii, quality, sharding, simhash, spans, spelling, vectors
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and number and first of its slots, of every document."""
    docs = mixing.taken_words(*mixing.mix_sources(table(spark, sf_dir, "documents")))
    return docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "slots", "first_slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    docs = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return docs.select(
        "doc_id", size.cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_shared, removed (start:end, ...), kept_chars of every document."""
    found = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "n_shared", "removed", F.coalesce(F.length("text"), F.lit(0)).alias("kept_chars"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, numbers of added and of all, of every document."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.digest(found)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify_languages(docs.select("doc_id", "text"), language.fit_dictionaries(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment of every document and benchmark item that it contains."""
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, evidence, prior and score for quality and toxicity, keep, toxic of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: differences of every source to the others and to its language."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents with two or more occurrences."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_sharding, op4_spans, op5_personal_data, op6_language, op7_licenses, op8_vectors, op9_decontamination, op10_quality, op11_main_text, op12_divergence, op13_spelling)
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Where SQL can express the result; the others are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {
    "op8_vectors": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(root) AS component_id, min(root) = r.vec_id AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id""",
    "op9_decontamination": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
t AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s))),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS shared FROM s JOIN t ON s.k = t.k AND s.run = t.run GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles""",
    "op12_divergence": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS terms, sum(total) AS lang_size FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(z.size), 0) AS size, coalesce(any_value(v.terms), 0) AS terms FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY 1, 2) z USING (lang, source) LEFT JOIN v USING (lang) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.size + 5 * g.terms)::HUGEINT AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (total + 5)::HUGEINT) // (lang_size + 5 * terms)::HUGEINT AS q FROM k JOIN v USING (lang)),
a AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, a.item, coalesce(f.value, 0)::BIGINT AS value FROM a LEFT JOIN f USING (lang, source, item)
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
