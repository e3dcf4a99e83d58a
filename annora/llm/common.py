"""What several operators share: tables, digests, scratch tables, connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annora.session import shared_dir


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables that this process has written and not removed, by folder.
_scratch: dict[str, DataFrame] = {}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        del _scratch[name]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables of all operators so far; DataFrames that operators returned can't be read any more."""
    _remove(spark, list(_scratch))


def release(*tables: DataFrame) -> None:
    """Removes tables that stored() has returned, once all that is still to be computed from them has been stored itself."""
    for table_ in tables:
        _remove(table_.sparkSession, [path for path, df in _scratch.items() if df is table_])


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = _scratch[path] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Sees to it that batches of rows that go to Python hold about `most` bytes at most, however long the texts are.

    Spark cuts them at a count of rows, or at far more bytes: several times that, per task, would be held by the JVM and by Python.
    The setting is the session's, as a DataFrame is run after the operator that made it has returned; a lower one is left alone.
    """
    found = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(BATCH_BYTES).strip().lower())
    if not found or int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] > most:
        spark.conf.set(BATCH_BYTES, str(most))


def digest_number(text: Column, digits: int) -> Column:
    """The first hex digits (15 at most) of a text's MD5 as a non-negative long; SQL engines agree on it, unlike on their own hashes."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do, by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def id_text(doc_id: Column, text: Column) -> Column:
    """What stands for a row in a shuffled order: its id and a digest of its text, so that rows that share an id, or have none, draw places of their own."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the smallest node that links reach.

    Alternates large-star and small-star steps, each a min per node and a join, until nothing changes: a logarithmic number of
    rounds in practice, whatever the shape. No task gathers a node's neighbours in memory, and each round is checkpointed.
    """
    shared_dir(edges.sparkSession)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    was = state(cur)
    while was[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Apart from the join, so that a node with very many neighbours can be dealt to several tasks.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        # Large star: larger neighbours of u hang below the smallest that u knows.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: u and its smaller neighbours hang below the smallest of them.
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur = small.checkpoint()
        now = state(cur)
        if now == was:
            break
        was = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
