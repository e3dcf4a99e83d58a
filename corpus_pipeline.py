"""The corpus pipeline: five stages, each of which works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annora.llm.common import stored, table
from annora.llm.op1_sharding import interleaved_shards
from annora.llm.op3_decontamination import without_leaks
from annora.llm.op5_mixing import mix_sources, quality_weights
from annora.llm.op6_toxicity import fit_lexicon, score_toxicity, training_labels
from annora.llm.op10_ngram_join import one_per_component

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 16


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more.

    Null and empty texts score as texts without a match, and stay, as do rows without an id; repeated rows go or stay together. Without
    labels, or with one class, the score is the class's share. Only the columns of documents are returned, here and by the next three stages.
    """
    lexicon = fit_lexicon(docs, training_labels(spark, table(spark, sf_dir, "labels")))
    return score_toxicity(docs.select(*COLUMNS), lexicon).where("tox_score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by sets of 5-word shingles with a similarity of 0.8 or more.

    Texts that are null or hold no words are linked with nothing, and stay all. Rows are told apart by id and text: of rows equal in both one
    stays, and rows that share an id, or have none, go only for what their own text is.
    """
    return one_per_component(docs.select(*COLUMNS), width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget.

    Null and empty texts hold none, and stay; null and empty items are in no document. Repeated rows go or stay together.
    """
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents so that sources meet their targets; a document taken n times is n rows.

    Rows are told apart by a 64-bit hash of all columns, so that rows without an id and rows that share one keep their own counts;
    rows equal in every column share the sum of theirs as evenly as it goes.
    """
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]))
    mixed = mix_sources(rows, quality_weights(table(spark, sf_dir, "labels")), keep=("row_key",))
    times = mixed.groupBy("row_key").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    copies = F.expr("times div rows") + (place <= F.col("times") % F.col("rows")).cast("long")
    dealt = rows.join(times, "row_key").withColumn("copies", copies).where("copies > 0")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot. Every row gets a place, repeated rows and rows without text or id included."""
    return interleaved_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Scores and edit distances aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
