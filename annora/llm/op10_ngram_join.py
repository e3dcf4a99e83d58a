"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annora.llm.common import bounded_batches, components, stored
from annora.llm.shingles import class_of, shingle_set

SKETCH_BITS, CHUNKS = 20, 64
BINS = 32
SIEVE_BITS = 20
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def _batch(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, key, class, n) per document, and at the end of each partition its counts of shingles by the hash's first bits, in chunks.

    key is a hash of the text, which with the id tells rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64()] * 4 + [pa.int32(), pa.binary()], ["doc_id", "key", "class", "n", "chunk", "counts"]
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids, row_keys, classes, sizes = batch.column(0), batch.column(1), [], []
            waiting, held = [], 0
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width)
                classes.append(class_of(s))
                sizes.append(len(s))
                waiting.append(s)
                held += len(s)
                if held > 1 << 19:
                    counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                    waiting, held = [], 0
            if waiting:
                counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            yield _batch([ids, row_keys, classes, sizes, [None] * len(classes), [None] * len(classes)], kinds, names)
        if counts.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
            none = [None] * CHUNKS
            yield _batch([none, none, none, none, list(range(CHUNKS)), parts], kinds, names)

    rows = docs.select(_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, class long, n long, chunk int, counts binary")


def _frequencies(parts: DataFrame) -> np.ndarray:
    """The sum of all partitions' counts: 2**SKETCH_BITS numbers, whatever the input's size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // CHUNKS, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.int64)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    dealt = parts.select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(256)).alias("salt"))
    rows = dealt.groupBy("chunk", "salt").applyInPandas(add, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.int64)
    for r in rows:
        out[r.chunk] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def prefix_length(n: int, num: int, den: int) -> int:
    """A set of n shares one of its first prefix_length(n) elements with any set that it is similar enough to."""
    return n - -(-num * n // den) + 1


def _prefixes(docs: DataFrame, width: int, num: int, den: int, frequencies) -> DataFrame:
    """Each document's rarest shingles (rarest first, ties by hash) as far as the prefix goes, and how its shingles spread over BINS ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequencies.value
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())], ["doc_id", "class", "n", "tokens", "bins"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                if len(s):
                    order = np.lexsort((s, often[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[: prefix_length(len(s), num, den)]
                    bins = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=BINS)
                    for c, v in zip(out, (doc_id, class_of(s), len(s), s[order].view(np.int64), bins), strict=True):
                        c.append(v)
            yield _batch(out, kinds, names)

    rows = docs.select(_id(F.col("doc_id")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, class long, n long, tokens array<long>, bins array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, set) of the classes in wanted (class, doc_id), from their documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            named = batch.column(1).to_pylist()
            same = [i for i, s in enumerate(sets) if class_of(s) == named[i]]  # rows that only share the id fall out
            yield _batch([[named[i] for i in same], [sets[i].view(np.int64) for i in same]], [pa.int64(), pa.list_(pa.int64())], ["class", "set"])

    rows = docs.select(_id(F.col("doc_id")).alias("doc_id"), "text").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE_BITS)).cast("int"))
    # Sieve before the shuffle: what is broadcast are 2**SIEVE_BITS small numbers at most, whatever the input's size; the join below decides.
    buckets = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE_BITS)).cast("int").alias("bucket")).distinct()
    rows = rows.join(F.broadcast(buckets), "bucket", "left_semi").join(wanted, "doc_id").select("text", "class")
    return rows.mapInArrow(run, "class long, set array<long>")


def _links(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the candidate pairs (a, b) of classes that are similar enough."""
    left = stored(_survivors(pairs, firsts, num, den), "ngram-candidates")
    wanted = left.select(F.col("a").alias("class")).unionByName(left.select(F.col("b").alias("class"))).distinct().join(classes, "class")
    return stored(_verified(left, stored(_sets(docs, wanted, width), "ngram-sets"), num, den).distinct(), "ngram-links")


def _required(n: Column, m: Column, num: int, den: int) -> Column:
    """What sets of n and m elements share at least if they are similar enough."""
    return F.ceil(F.lit(num) * (n + m) / F.lit(float(num + den)) - 1e-9)


def _survivors(pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """Suffix filter: what two sets share is at most what they share in the counts of each range of the hash."""
    a = firsts.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba"))
    b = firsts.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb"))
    most = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(most >= _required(F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, class, n, root) of every row of docs: what ngram_components() tells, by class; a null id is NO_ID. Stored.

    1. Documents with equal sets are one class, and each class takes part once. The same scan counts shingles in 2**20 hash buckets.
    2. Each class posts its rarest shingles (by bucket count, then hash): as many as any similar set must share one of.
    3. Postings of shingles that two classes share are paired, each pair verified once on whole sets. Length filter: sizes allow the
       similarity. Positional filter: what follows the shared shingle in both sets suffices. Suffix filter: so do the counts by hash
       range. Pairs are made in two rounds: first each posting with two leaders of its shingle (the one that has it first, which is
       the original in a group of edited copies, and the one of the smallest class); then all postings of a shingle that are not in
       one component yet, so that a group of m copies costs about m pairs and no link between components is lost.

    """
    bounded_batches(docs.sparkSession)
    scan = stored(_scan(docs, width), "ngram-scan")
    slim = scan.where("chunk is null").select("doc_id", "key", "class", "n")
    frequencies = docs.sparkSession.sparkContext.broadcast(_frequencies(scan.where("chunk is not null")))
    classes = stored(slim.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "ngram-classes")
    firsts = stored(_prefixes(docs, width, num, den, frequencies).join(classes, ["class", "doc_id"], "left_semi").dropDuplicates(["class", "doc_id"]), "ngram-prefixes")
    postings = firsts.select("class", "n", F.posexplode("tokens").alias("pos", "token"))
    common = postings.groupBy("token").count().where("count > 1").select("token")
    shared = stored(postings.join(common, "token"), "ngram-shared")

    def fits(n: str, p: str, m: str, q: str) -> Column:
        a, b = F.col(n), F.col(m)
        return (F.least(a, b) * den >= F.greatest(a, b) * num) & (F.least(a - F.col(p), b - F.col(q)) >= _required(a, b, num, den))

    leaders = shared.groupBy("token").agg(F.min(F.struct("pos", "class", "n")).alias("x"), F.min(F.struct("class", "n", "pos")).alias("y"))
    each = shared.join(leaders, "token")
    near = None
    for who in ("x", "y"):
        found = each.select("class", "n", "pos", F.col(f"{who}.class").alias("c2"), F.col(f"{who}.n").alias("n2"), F.col(f"{who}.pos").alias("p2")).where(F.col("class") != F.col("c2"))
        found = found.where(fits("n", "pos", "n2", "p2")).select(F.least("class", "c2").alias("a"), F.greatest("class", "c2").alias("b"))
        near = found if near is None else near.unionByName(found)
    tried = stored(near.distinct(), "ngram-led")
    links = _links(tried, docs, firsts, classes, width, num, den)
    part = stored(components(links), "ngram-parts")

    rooted = shared.join(part.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    left = stored(rooted.join(open_, "token"), "ngram-open")
    other = left.select("token", *[F.col(c).alias(f"{c}2") for c in ("class", "n", "pos", "root")])
    rest = left.join(other, "token").where(F.col("class") < F.col("class2")).where("root <> root2").where(fits("n", "pos", "n2", "pos2"))
    more = rest.select(F.col("class").alias("a"), F.col("class2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    whole = components(links.unionByName(_links(more, docs, firsts, classes, width, num, den)))

    of_class = stored(whole.withColumnRenamed("node", "class"), "ngram-whole")
    return stored(slim.join(of_class, "class", "left").withColumn("root", F.coalesce("root", "class")), "ngram-placed")


def ngram_components(docs: DataFrame, *, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Documents (doc_id, text) grouped by links between shingle sets whose Jaccard similarity is num / den or more; see grouped().

    Edge cases: null, empty and blank texts have no shingles and link with nothing; repeated rows are one class, and so are rows
    that share an id but not their text where these are similar; a null id is kept and never anyone's component_id unless all of the
    component's are null; an empty table gives no rows; other columns are ignored.

    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach).
    """
    placed = grouped(docs, width, num, den)
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    # Stored before it meets the rows, so that those of a large component can be dealt to several tasks.
    smallest = stored(placed.where("n > 0").groupBy("root").agg(F.min(own).alias("low")), "ngram-smallest")
    out = placed.join(smallest, "root", "left")
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(own).alias("component_id"))


def one_per_component(docs: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """docs, all columns, with one row of each component; rows without words all stay.

    It is the row of the smallest doc_id (null last; of rows that share it, that of the smallest hash of its text). Rows are told
    apart by id and text, so that a decision touches no other row that shares an id. Of rows equal in both, one stays: that of the
    smallest hash of all columns. An empty table gives no rows.
    """
    placed = grouped(docs, width, num, den)
    best = placed.where("n > 0").groupBy("root").agg(F.min(F.struct((F.col("doc_id") == NO_ID).alias("none"), "doc_id", "key")).alias("x"))
    best = stored(best.select("x.doc_id", "x.key"), "ngram-best").alias("b")
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = docs.where(~blank).alias("d")
    kept = rows.join(best, (_id(F.col("d.doc_id")) == F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.key")))
    one = Window.partitionBy(_id(F.col("d.doc_id")), F.xxhash64("d.text")).orderBy(F.xxhash64(*[F.col(f"d.`{c}`") for c in docs.columns]))
    first = kept.select(F.struct("d.*").alias("row"), F.row_number().over(one).alias("place")).where("place = 1").select("row.*")
    return docs.where(blank).unionByName(first)
