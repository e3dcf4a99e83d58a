"""Substring dedup: every passage of so many words that has occurred before, found by windows sampled at places their own words choose."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annora.llm.common import bounded_batches, release, stored

EDGE = ".,;:!?\"'()[]{}«»„“”‘’…-"
#: Texts are worked on together up to so many code points.
CHUNK = 1 << 20
#: Bits of a sieve for each of its keys, and the binary logarithms of its least and greatest size (32 MB).
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 32, 15, 28
#: Whether a code point is a space, as str.split() sees it; beyond the table none is.
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class _Words(dict):
    """word -> the hash of its normal form, for a bounded number of words."""

    most = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(EDGE).lower().encode("utf-8", "surrogatepass"))
        return value


_words = _Words()


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in order."""
    x = a * ODD[0] + (b ^ (b >> np.uint64(29))) * ODD[1]
    x ^= x >> np.uint64(32)
    x *= ODD[2]
    x ^= x >> np.uint64(29)
    return x


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` neighbours in h; equal ones are equal wherever they stand."""
    p = 1
    while 2 * p <= size:
        h = _both(h[:-p], h[p:])
        p *= 2
    return h if p == size else _both(h[: len(h) - (size - p)], h[size - p :])


def _least(v: np.ndarray, size: int) -> np.ndarray:
    """The place of the least (the first of equal ones) of every `size` neighbours in v."""
    at, p = np.arange(len(v)), 1
    while p < size:
        step = min(p, size - p)
        later = v[step:] < v[:-step]
        v, at = np.where(later, v[step:], v[:-step]), np.where(later, at[step:], at[:-step])
        p += step
    return at


class Pieces:
    """The windows of min_words words of some texts, in pieces: neighbouring windows that share the least hash of their shorter grams.

    A window's least gram depends on its own words only, so that equal windows lie in pieces of the same digest whatever stands
    around them. A window is min_words words, a gram a little over half of them, so there is a piece for about every eighth word at 30.
    """

    def __init__(self, texts: list[str], min_words: int) -> None:
        w = max(1, min_words // 2)
        found = [np.fromiter(map(_words.__getitem__, t.split()), np.uint64) for t in texts]
        count = np.array([len(f) for f in found], np.int64)
        self.texts, self.words = texts, np.concatenate([*found, np.empty(0, np.uint64)])
        self.base = np.cumsum(count) - count
        self.text_of = np.repeat(np.arange(len(texts)), count)
        self.min_words = min_words
        n = len(self.words) - min_words + 1
        inside = np.flatnonzero(self.text_of[:n] == self.text_of[min_words - 1 :]) if n > 0 else np.empty(0, np.int64)
        if not len(inside):
            self.text = self.low = self.size = self.digest = np.empty(0, np.int64)
            return
        short = _grams(self.words, min_words - w + 1)
        least = _least(short, w)[inside]
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        self.low = inside[begin]
        self.size = np.diff(np.append(begin, len(inside)))
        self.text = self.text_of[self.low]
        self.digest = short[least[begin]].view(np.int64)

    @cached_property
    def window(self) -> np.ndarray:
        """A hash of every min_words neighbouring words."""
        return _grams(self.words, self.min_words)

    @cached_property
    def whole(self) -> np.ndarray:
        """A digest of each piece with all its windows: these overlap, so its first and last and their number tell them all."""
        if not len(self.low):
            return np.empty(0, np.int64)
        ends = _both(self.window[self.low], self.window[self.low + self.size - 1])
        return _both(ends, self.size.astype(np.uint64)).view(np.int64)

    @cached_property
    def spots(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends, in code points of its text."""
        # A space after each text keeps its last word apart from the next text's first.
        points = np.frombuffer(" ".join([*self.texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = SPACE[np.minimum(points, len(SPACE) - 1)]
        first = np.cumsum([0] + [len(t) + 1 for t in self.texts])[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        return edge[::2] - first[self.text_of], edge[1::2] - first[self.text_of]

    def places(self, low: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, size) of so many windows from each word of low on: at is first << 32 | last code point, size first word << 32 | windows."""
        start, end = self.spots
        return start[low] << 32 | end[low + windows + self.min_words - 2], low - self.base[self.text_of[low]] << 32 | windows


def _chunks(columns: list[list]) -> Iterator[list[list]]:
    """Rows of columns, the last of which are texts, in parts of CHUNK code points or one row."""
    begin = chars = 0
    for i, text in enumerate(columns[-1]):
        if chars and chars + len(text) > CHUNK:
            yield [c[begin:i] for c in columns]
            begin, chars = i, 0
        chars += len(text)
    if begin < len(columns[-1]):
        yield [c[begin:] for c in columns]


def _sieve(keys: DataFrame) -> Broadcast:
    """Bits that tell which hashes may be among keys (key long, stored): all that are, and few others. Their size has a bound; beyond it more others pass."""
    log = min(SIEVE_MOST, max(SIEVE_LEAST, (SIEVE_BITS * keys.count()).bit_length()))
    # Two bits for each key, from its lower parts: the upper bits of least hashes are not uniform.
    marked = keys.select(F.explode(F.array(*(F.shiftright("key", i).bitwiseAND(F.lit((1 << log) - 1)) for i in (0, SIEVE_MOST)))).alias("place"))
    parts = marked.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    bits = np.zeros((1 << log - 15, 1 << 12), np.uint8)
    for r in parts.collect():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def _passed(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the hashes pass a sieve."""
    some = np.arange(len(key))
    for i in (0, SIEVE_MOST):
        place = key[some] >> i & (len(bits) * 8 - 1)
        some = some[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
    return some


def _digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (texts,) in _chunks([batch.column(0).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array(Pieces(texts, min_words).digest)], names=["digest"])

    return _rows(docs).select("text").mapInArrow(run, "digest long")


def _pieces(docs: DataFrame, often: Broadcast, min_words: int) -> DataFrame:
    """(doc_id, key, at, size, digest, whole) of every piece whose digest passes the sieve, with at and size as in Pieces.places()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, _, texts in _chunks([c.to_pylist() for c in batch.columns]):
                p = Pieces(texts, min_words)
                some = _passed(often.value, p.digest)
                if len(some):
                    of = pa.array(p.text[some])
                    arrays = [*p.places(p.low[some], p.size[some]), p.digest[some], p.whole[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(of), pa.array(keys, pa.int64()).take(of), *map(pa.array, arrays)], names=["doc_id", "key", "at", "size", "digest", "whole"])

    return _rows(docs).mapInArrow(run, "doc_id long, key long, at long, size long, digest long, whole long")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), row (a hash of both) and text, where there is one."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    return rows.select("doc_id", "key", F.xxhash64("doc_id", "key").alias("row"), "text")


def _windows(docs: DataFrame, wanted: Broadcast, min_words: int) -> DataFrame:
    """(doc_id, key, at, size, window) of every window of the pieces that pass the sieve by their _mark(), with at and size as in Pieces.places()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, rows, texts in _chunks([c.to_pylist() for c in batch.columns]):
                p = Pieces(texts, min_words)
                some = _passed(wanted.value, _mark(np.array(rows, np.int64)[p.text], p.whole, p.low - p.base[p.text]))
                if len(some):
                    size = p.size[some]
                    low = np.repeat(p.low[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    of = pa.array(p.text_of[low])
                    arrays = [*p.places(low, np.ones_like(low)), p.window[low].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(of), pa.array(keys, pa.int64()).take(of), *map(pa.array, arrays)], names=["doc_id", "key", "at", "size", "window"])

    return _rows(docs).mapInArrow(run, "doc_id long, key long, at long, size long, window long")


def _word(size: str) -> Column:
    return F.shiftright(size, 32)


def _mark(row: np.ndarray, whole: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What stands for a piece of a row in a sieve: its first word's number changes both of the sieve's places."""
    return row ^ whole ^ word ^ word << SIEVE_MOST


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """What repeated_spans() returns, with key, a hash of the text, which with the id tells rows apart."""
    often = stored(_digests(docs, min_words).groupBy("digest").count().where("count > 1").select(F.col("digest").alias("key")), "substring-often")
    sieve = _sieve(often)
    repeated = stored(_pieces(docs, sieve, min_words), "substring-repeated")
    sieve.destroy()
    release(often)
    who = F.min(F.struct("doc_id", "key", "size")).alias("first")
    first = stored(repeated.groupBy("whole").agg(who, F.min("digest").alias("digest"), F.count("*").alias("times")), "substring-first")
    itself = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("size") == F.col("first.size"))
    # Both sides are shuffled whatever their size, so that what is shuffled grows with the input and doesn't leap.
    later = repeated.drop("digest").hint("merge").join(first.where("times > 1").select("whole", "first"), "whole").where(~itself)

    various = first.groupBy("digest").count().where("count > 1").select("digest")
    word = _word("first.size")
    mark = F.xxhash64("first.doc_id", "first.key").bitwiseXOR(F.col("whole")).bitwiseXOR(word).bitwiseXOR(F.shiftleft(word, SIEVE_MOST))  # as _mark()
    wanted = stored(first.select("digest", mark.alias("key")).hint("merge").join(various, "digest", "left_semi").select("key"), "substring-wanted")
    sieve = _sieve(wanted)
    windows = stored(_windows(docs, sieve, min_words), "substring-windows")
    sieve.destroy()
    release(wanted)
    seen = stored(windows.groupBy("window").agg(who, F.count("*").alias("times")).where("times > 1").drop("times"), "substring-seen")
    again = windows.hint("merge").join(seen, "window").where(~itself)

    columns = ("doc_id", "key", "size", "at", F.col("first.doc_id").alias("first_doc_id"))
    found = later.select(*columns, F.lit(False).alias("alone")).unionByName(again.select(*columns, F.lit(True).alias("alone")))
    rows = found.select(
        "doc_id", "key", _word("size").alias("k"), F.expr("size & 4294967295").alias("n"),
        F.shiftright("at", 32).alias("start"), F.expr("at & 4294967295").alias("end"), "first_doc_id", "alone",
    ).withColumn("stop", F.col("k") + F.col("n") + (min_words - 1))
    by_doc = Window.partitionBy("doc_id", "key").orderBy("k", "alone", "n", "first_doc_id")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    # Windows inside a piece that is found whole come from pieces that passed the sieve by chance.
    met = rows.withColumn("met", F.max(F.when(~F.col("alone"), F.col("k") + F.col("n"))).over(before)).where("not alone or met is null or met <= k")
    marked = met.withColumn("reached", F.max("stop").over(before)).withColumn("fresh", F.lag("k").over(by_doc).isNull() | (F.lag("k").over(by_doc) < F.col("k")))
    runs = marked.withColumn("run", F.sum((F.col("reached").isNull() | (F.col("k") > F.col("reached"))).cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("doc_id", "key", "run")
    out = runs.agg(
        F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), (F.max("stop") - F.min("k")).alias("n_words"),
        F.sum(F.col("fresh").cast("long")).alias("n_units"), F.max_by("first_doc_id", F.struct("n", "start")).alias("first_doc_id"),
    )
    return out.select("doc_id", "key", "start", "end", "n_words", "n_units", "first_doc_id")


def repeated_spans(docs: DataFrame, *, min_words: int = 30) -> DataFrame:
    """Spans of docs (doc_id, text) to remove: what windows of min_words words cover that have occurred before, in order of (doc_id, place).

    Each passage of min_words words or more that stands whole in an earlier place is found, wherever it begins and ends; words are
    compared in lower case without punctuation at their edges, spaces and line ends all alike. A window may overlap its own first
    occurrence, so that of a text that goes round the first round stays.

    Windows that repeat share the digest of their piece. Pieces equal as a whole repeat with all their windows; only where pieces of
    one digest differ, at the ends of passages, the first of each kind is taken apart into windows, which are compared one by one.
    Digests are counted first and firsts are stored, so that no task gathers the places of one digest. docs is read three times: to
    count digests, for the pieces that repeat, and for the windows; sieves sent to all tasks tell which, so that no text is shuffled
    and a piece that occurs once is neither stored nor shuffled but for its digest. What passes a sieve by chance changes nothing.

    Edge cases: null, empty and blank texts have no windows; equal rows with one id count as one document; a null id ranks first
    and is kept apart; other columns are ignored.

    Returns doc_id, start, end (code points of the original text), n_words, n_units (pieces found), first_doc_id (where the piece of the
    most windows occurs first).
    """
    return _spans(docs, min_words).drop("key")


def without_repeats(docs: DataFrame, *, min_words: int = 30) -> DataFrame:
    """docs, all columns, whose text lacks the spans of repeated_spans(); removed_spans retains their original offsets (null: none), and replaces a column so named.

    Rows are told apart by id and text, a null id included, so that a row that shares the id of another loses only its own spans;
    rows equal in both lose the same.
    """
    rows = docs.drop("removed_spans")
    each = _spans(docs, min_words).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    d, s = rows.alias("d"), each.alias("s")
    joined = d.join(s, F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.key")), "left")
    text, spans = F.col("d.text"), F.col("s.spans")
    begin = F.concat(F.array(F.lit(0)), spans["end"])
    stop = F.concat(spans["start"], F.array(F.length(text)))
    kept = F.array_join(F.zip_with(begin, stop, lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))), "")
    columns = [F.when(spans.isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"d.`{c}`") for c in rows.columns]
    return joined.select(*columns, spans.alias("removed_spans"))
