"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annora.llm.common import digest_number, id_text, source_key

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 13


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sizes (skey, source_size) with each source's target: shares of the total by weight (repeating in key order), none above cap times its size.

    Capping sources one after the other by the ratio of cap to weight, smallest first, ends where resharing the excess until none is
    above ends; the first source that isn't capped sets the words per weight of all that follow.
    """
    one = Window.partitionBy(F.lit(0))
    by_key, by_ratio = one.orderBy("skey"), one.orderBy("ratio", "skey")
    to_here = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return (
        sizes.withColumn("w", F.get(w, (F.row_number().over(by_key) - 1) % len(weights)))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("rn", F.row_number().over(by_ratio))
        .withColumn("level", (F.sum("source_size").over(one) - (F.sum("most").over(to_here) - F.col("most"))) / F.sum("w").over(from_here))
        .withColumn("first", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("rn", "level"))).over(one))
        .select("skey", "source_size", F.when(F.col("rn") >= F.col("first.rn"), F.col("w") * F.col("first.level")).otherwise(F.col("most")).alias("target"))
    )


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 29, buckets: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, source) with how many words of each document the mixture takes.

    A source's target is its share by weight of all words, at most cap times its own. It takes each document floor(target / source)
    times (complete epochs), then some once more: documents are sorted by the exponential key -ln(u) / quality, u being a uniform
    number drawn from seed, doc_id and text, their sizes are summed up in that order, and a document is taken if the middle of its words
    is within what is left of the budget, so that the sum misses the target by half a document at most. The running sums are exact:
    per bucket of the key first, then within a bucket, so that no task holds a source.

    quality: optional (doc_id, quality > 0), one row per id; missing ones count as 1. It scales how soon a document is taken again.

    Edge cases: null or empty text has size 0 and takes 0; a null source is a source of its own, sorted last; equal rows are taken
    apart from each other; sources without words have target 0; an empty table gives no rows; other columns are ignored. At most cap
    times its size is taken of a document.

    keep: short columns of docs to carry along, under names that aren't among those returned.

    Returns doc_id, size, source_size, target, taken; with it skey (the source's key), times (copies to make) and keep.
    """
    rows = docs.select(
        *keep,
        "doc_id",
        source_key(F.col("source")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest_number(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"), F.col("text"))), DIGITS).alias("h"),
    )
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id"), F.col("quality").cast("double")), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    rows = rows.withColumn("e", -F.log((F.col("h") + 0.5) / float(16**DIGITS)) / F.coalesce("quality", F.lit(1.0)))
    rows = rows.withColumn("b", F.floor((1 - F.exp(-F.col("e"))) * buckets).cast("int")).select(*keep, "doc_id", "skey", "size", "e", "b")

    ahead = Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy("skey", "b").agg(F.sum("size").alias("s"))
    plan = targets(part.groupBy("skey").agg(F.sum("s").alias("source_size")), weights, cap)
    offsets = part.select("skey", "b", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before")).join(plan, "skey")
    within = Window.partitionBy("skey", "b").orderBy("e", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        rows.withColumn("to_here", F.sum("size").over(within))
        .join(offsets, ["skey", "b"])
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("again", (F.col("size") > 0) & (F.col("before") + F.col("to_here") - F.col("size") / 2.0 <= F.col("rest")))
        .withColumn("times", (F.col("epochs") + F.col("again").cast("int")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "skey", "times", *keep)
    )


def quality_weights(labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """labels (doc_id, quality 0/1) as one weight per id; the better of contradicting labels holds, null labels are left out."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("q"))
        .select("doc_id", F.when(F.col("q") > 0, good).otherwise(poor).alias("quality"))
    )
