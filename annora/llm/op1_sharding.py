"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annora.llm.common import digest_number, id_text, source_key

DIGITS = 15


def interleaved_shards(docs: DataFrame, shards: int = 16, *, seed: int = 17, bits: int = 12) -> DataFrame:
    """Deals every row of docs (doc_id, text, source) to shards whose row counts differ by one at most and whose mixture of sources is the whole's.

    Rows are ranked in a seeded shuffled order within each source; rank r of n becomes the fraction (r + u) / n, with a shift u in
    [0, 1) of the source's own so that small sources spread too; rows are sorted by fraction and cut at equal counts. Ranks and
    places are exact, and found without gathering a source: rows are counted in 2**bits buckets of the sorted value, the counts are
    summed up, and rows are numbered within a bucket only. No text is moved: its size and checksum are taken while scanning.

    Law: rows. Edge cases: null text has size 1 and checksum 0; a null source is a source of its own; null ids and repeated rows are
    dealt as any other row (equal rows take neighbouring places); an empty table gives no rows; other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: growing is the key law's).
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("skey"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        digest_number(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"), F.col("text"))), DIGITS).alias("h"),
    ).withColumn("hb", F.shiftright("h", 4 * DIGITS - bits))

    ahead = Window.partitionBy("skey").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    strata = (
        rows.groupBy("skey", "hb")
        .agg(F.count("*").alias("c"))
        .select(
            "skey",
            "hb",
            F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"),
            F.sum("c").over(Window.partitionBy("skey")).alias("n"),
        )
    )
    shift = digest_number(F.concat(F.lit(f"{seed}/"), "skey"), 13) / F.lit(float(16**13))
    order = ("h", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("r", F.row_number().over(Window.partitionBy("skey", "hb").orderBy(*order)))
        .join(strata, ["skey", "hb"])
        .withColumn("f", (F.col("before") + F.col("r") - 1 + shift) / F.col("n"))
        .withColumn("fb", F.floor(F.col("f") * (1 << bits)).cast("int"))
        .select("doc_id", "skey", "size", "text_crc32", "h", "f", "fb")
    )
    places = (
        ranked.groupBy("fb")
        .agg(F.count("*").alias("c"))
        .select(
            "fb",
            F.coalesce(F.sum("c").over(Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("c").over(Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        )
    )
    return (
        ranked.withColumn("r", F.row_number().over(Window.partitionBy("fb").orderBy("f", "skey", *order)))
        .join(places, "fb")
        .withColumn("g", F.col("before") + F.col("r") - 1)
        .withColumn("shard", F.expr(f"g * {shards} div total"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            F.expr(f"g - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
