"""Shared helpers: table access, checkpoints on the shared folder, words, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is used
    only in local mode with that setting absent; a cluster without it is an error,
    since executors don't share a machine's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or "/tmp/checkpoints")
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as parquet below the checkpoint folder and read back, and the new folder; a fraction of what ``materialize``
    writes for long tables of numbers. Whoever no longer reads it drops it with ``drop_folder``."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store that one of our steps has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text; rows equal in both share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a second form of the join keys, ``_apart``.

    Joining on the keys and ``_apart`` makes Spark exchange both sides for the join
    itself, even a side that an aggregate has left partitioned by the keys. Adaptive
    execution splits hot partitions only of such exchanges.
    """
    return df.withColumn("_apart", F.xxhash64(*[F.col(k) for k in keys]))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges that adaptive execution shouldn't make few."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its scan has fewer (one file with a single row group is one
    partition); many files stay as they are. For steps whose work on a row is far above that of moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
