"""Source divergence audit: term distributions of sources, compared by hash-consed segment trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annora.llm.common import bounded_batches, stored

#: Letters stay, A-Z as a-z, with all that isn't ASCII; other bytes part terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Term counts that a task holds before it passes them on.
HELD = 1 << 18
#: Terms of a block, and sources of a chunk: what a task compares.
BLOCK, CHUNK = 512, 64
#: A probability in billionths is reckoned in two steps of these factors, so that nothing overflows while a denominator is below 2.8e14.
BILLION = (31_250, 32_000)
PAIR = "lang string, a string, b string, value long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term's docs are all documents of the group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                terms = list(docs_)
                columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs_[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (lang, source)
                if key not in held:
                    held[key] = Counter(), Counter()
                n, docs_ = held[key]
                terms = terms_of(text)
                was = len(docs_)
                n.update(terms)
                docs_.update(set(terms))
                docs_[None] += 1
                size += len(docs_) - was
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    bounded_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    each = texts.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def billionths(count: Column, total: Column, kinds: Column, more: int) -> Column:
    """1 + floor(10**9 * (count + more) / (total + more * kinds)), exactly."""
    a, b = BILLION
    x, d = (count + more) * F.lit(a).cast("long"), total + more * kinds
    return F.call_function("div", x, d) * b + F.call_function("div", (x % d) * F.lit(b).cast("long"), d) + 1


def billionths_of(count: np.ndarray, total: np.ndarray, kinds: int, more: int) -> np.ndarray:
    a, b = BILLION
    x, d = (count.astype(np.int64) + more) * a, total + more * kinds
    return x // d * b + x % d * b // d + 1


class Trees:
    """Segment trees over the columns of a matrix of counts, one per row; equal subtrees, of whatever rows, are one node.

    root: the top node of each row. levels: from the top down to the leaves' parents, the left and right child of each node.
    """

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaf, ids = np.unique(padded, return_inverse=True)
        ids, self.levels = ids.reshape(padded.shape), []
        while ids.shape[1] > 1:
            most = int(ids.max()) + 1
            both, inverse = np.unique(ids[:, ::2] * most + ids[:, 1::2], return_inverse=True)
            self.levels.insert(0, (both // most, both % most))
            ids = inverse.reshape(len(ids), -1)
        self.root = ids[:, 0]

    def prices(self, row: int, others: np.ndarray, totals: np.ndarray, kinds: int, more: int) -> np.ndarray:
        """For each of the other rows the sum over all columns of what the probabilities differ by.

        The two trees are gone through together, level by level. A pair of nodes that is met in several places is kept once, with how
        often it was met, and so gone into, and priced, once.
        """
        a, b, who = np.full(len(others), self.root[row]), self.root[others], np.arange(len(others))
        times = np.ones(len(others), np.int64)
        for left, right in self.levels:
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            who, times = np.tile(who, 2), np.tile(times, 2)
            high, wide = int(a.max()) + 1, int(b.max()) + 1
            key, inverse = np.unique((who * high + a) * wide + b, return_inverse=True)
            times = np.bincount(inverse, times, len(key)).astype(np.int64)
            a, b, who = key // wide % high, key % wide, key // wide // high
        real = self.leaf[a] >= 0
        a, b, who, times = self.leaf[a[real]], self.leaf[b[real]], who[real], times[real]
        apart = np.abs(billionths_of(a, totals[row], kinds, more) - billionths_of(b, totals[others[who]], kinds, more)) if len(a) else a
        out = np.zeros(len(others), np.int64)
        np.add.at(out, who, apart * times)
        return out


def _compared(more: int):
    """A block of terms: (lang, block, ca, cb) with its counts and its sources."""

    def work(key: tuple, rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        _, _, ca, cb = key
        groups = groups.sort_values("source").reset_index(drop=True)
        place = {s: i for i, s in enumerate(groups.source)}
        # Rare terms next to each other, where most subtrees hold nothing.
        terms = rows.groupby("term").n.agg(["sum"]).reset_index().sort_values(["sum", "term"], ascending=[False, True])
        column = {t: i for i, t in enumerate(terms.term)}
        counts = np.zeros((len(groups), len(column)), np.int64)
        counts[[place[s] for s in rows.source], [column[t] for t in rows.term]] = rows.n
        totals, chunk = groups.total.to_numpy(np.int64), groups.chunk.to_numpy()
        out: list[tuple[str, str, str, int]] = []
        trees = Trees(counts) if len(column) else None
        for i in np.flatnonzero(chunk == ca):
            others = np.flatnonzero((chunk == cb) & ((ca != cb) | (np.arange(len(groups)) > i)))
            if len(others):
                price = trees.prices(i, others, totals, int(groups.kinds[0]), more) if trees else np.zeros(len(others), np.int64)
                out += zip(groups.lang[others], [groups.source[i]] * len(others), groups.source[others], price.tolist(), strict=True)
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    return work


def divergence(docs: DataFrame, *, least_docs: int = 30, more: int = 5, top: int = 50) -> DataFrame:
    """How the sources of a language differ: lang, source, part, item, value, rank.

    Terms are runs of letters and of all that isn't ASCII; A-Z count as a-z. A language keeps the terms that least_docs or more of its
    documents have. A source gives a kept term the probability (in billionths, `billionths`) of its count with `more` added to each term's.
    part 'pair': item is another source of the language, value the sum over all kept terms of what their probabilities differ by.
    part 'term': item is a kept term that the source has, and has more than the language does, value by how much; the `top` largest.
    rank is 1 for the largest value of a source and part, ties by item. Null text, lang or source counts as ''; a source without kept
    terms gives all terms the same. An empty table gives no rows. Columns other than text, lang and source aren't read.

    A source's tree is a segment tree over the language's kept terms. Terms are dealt to blocks by hash; a task holds the subtrees
    of a block for two chunks of sources, equal ones as one node, and goes through the trees of two sources together
    (`Trees`). Blocks are then summed. What a task holds is bounded by BLOCK and CHUNK, however many terms and sources there are.
    """
    keys = ["lang", "source"]
    counted = stored(term_counts(docs), "divergence-terms")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    rows = stored(counted.join(kept.select("lang", "term", "all_n"), ["lang", "term"]).select(*keys, "term", "n", "all_n"), "divergence-kept")
    own = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    sizes = rows.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_total"))
    groups = counted.where("term is null").select(*keys).join(own, keys, "left").join(sizes, "lang", "left").fillna(0)
    groups = groups.join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n)
    blocks, chunks = F.greatest(F.lit(1), F.ceil(F.col("kinds") / BLOCK)), F.ceil(F.col("sources") / CHUNK)
    groups = stored(groups.withColumn("blocks", blocks).withColumn("chunks", chunks).withColumn("chunk", hashed("source", F.col("chunks"))), "divergence-groups")

    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    place = (F.least("chunk", "met").alias("ca"), F.greatest("chunk", "met").alias("cb"))
    known = groups.withColumn("met", met).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    known = known.select(*keys, "total", "kinds", "chunk", "block", *place)
    dealt = rows.join(groups.select(*keys, "blocks", "chunk", "chunks"), keys).withColumn("met", met).withColumn("block", hashed("term", F.col("blocks")))
    by = ["lang", "block", "ca", "cb"]
    priced = dealt.select(*keys, "term", "n", "block", *place).groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(_compared(more), PAIR)
    pairs = stored(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = [pairs.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]

    at = rows.join(groups.select(*keys, "total", "all_total", "kinds"), keys).where("n > 0")
    p, q = (billionths(F.col(n), F.col(total), F.col("kinds"), more) for n, total in (("n", "total"), ("all_n", "all_total")))
    over = at.select(*keys, F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    w = Window.partitionBy(*keys, "part").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(w)) for x in (both[0].unionByName(both[1]), over)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
