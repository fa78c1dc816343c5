"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from swathlab.llm import decontamination, language, mixing, near_copies, sharding
from swathlab.llm.common import drop_folder, ensure_checkpoint_dir, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; those rejected (also null or letterless texts) go.

    Dictionaries are fitted on the stage's own documents; a document's own ``lang`` isn't used on it. Repeated rows stay or go
    together; an empty table, or one without languages, gives an empty result.
    """
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):  # no column of the documents is touched
        prefix += "_"
    found = language.identify_languages(docs, language.fit_dictionaries(docs), prefix=prefix)
    return found.where(f"not {prefix}rejected").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the least id: SimHash at a similarity (cosine) of 0.8 of five-word shingles.

    Texts without words are copies of each other; repeated rows are one; an empty table gives an empty result.
    """
    return near_copies.deduplicate_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``. Null and empty texts stay; repeated rows stay or go together; without items all stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order (whole ones; see ``mixing.mixed_documents``). Those without words are in no mix."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot; null texts, repeated rows and ties are rows like others (see ``sharding.shard_documents``)."""
    return sharding.shard_documents(docs)


STAGES = [("language", identify), ("near-dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Compression and SimHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; stages in between are written to the shared folder, and dropped there once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
