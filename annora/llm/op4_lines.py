"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annora.llm.common import bounded_batches, components, release, stored

BLANKS = " \t\r\x0b\x0c"
#: Lines are worked on together up to so many code points.
CHUNK = 1 << 20
#: Bits of a plane of the sieve; its planes are sent in so many parts.
SIEVE_BITS, PARTS = 27, 64
#: Bins of the character counts that are compared before edit distances are.
BINS = 16
BLOCK = 512
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
BASE = 0xD6E8FEB86659FD93


def within(a: str, b: str, most: int) -> bool:
    """Whether a and b are at most so many edits apart; bit-parallel over a band of 2 * most + 1 diagonals.

    Word d holds a bit per diagonal that can be reached with d edits: bit e + most is a[: j + e] against b[:j]. The masks of a's
    characters are made for BLOCK places at a time, so that a step costs the same in lines of any length.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return False
    width = 2 * most + 1
    band = (1 << width) - 1

    def inside(j: int) -> int:
        """Diagonals on which 0 <= j + e <= m."""
        high = min(width, max(0, m - j + most + 1))
        return (1 << high) - 1 & ~((1 << max(0, most - j)) - 1)

    rows = [1 << most]
    for _ in range(most):
        rows.append((rows[-1] | rows[-1] << 1) & inside(0))
    for begin in range(0, n, BLOCK):
        masks: dict[str, int] = {}
        for i in range(max(0, begin - most), min(m, begin + BLOCK + most)):
            masks[a[i]] = masks.get(a[i], 0) | 1 << (i + most - begin)
        for j in range(begin, min(n, begin + BLOCK)):
            same, fits = masks.get(b[j], 0) >> (j - begin) & band, inside(j + 1)
            before, made = 0, 0
            for d, now in enumerate(rows):
                step = now & same | before | before >> 1 | made << 1
                before, made = now, step & fits
                rows[d] = made
            if not any(rows):
                return False
    return bool(rows[most] >> (m - n + most) & 1)


def edit_budget(shorter: int, edits: int, chars_per_edit: int) -> int:
    """How many edits may part two lines, the shorter of which has so many characters."""
    return min(edits, shorter // chars_per_edit)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that aren't blank, without blanks at their ends."""
    return [(no, line) for no, raw in enumerate(text.split("\n")) if (line := raw.strip(BLANKS))]


def line_id(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * ODD[0]
    x ^= x >> np.uint64(32)
    x *= ODD[1]
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return cls.up, cls.down


class Substrings:
    """Hashes of substrings of some lines, each from two running sums over the code points of all of them."""

    def __init__(self, lines: list[str]) -> None:
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.first = np.cumsum(self.n) - self.n
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, self.down = _Powers.to(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64)) * up[: len(points)], out=self.sums[1:])

    def of(self, rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        begin = self.first[rows] + at
        return (self.sums[begin + size] - self.sums[begin]) * self.down[begin]


def keys(lines: list[str], edits: int, chars_per_edit: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the lines' own segments, and of the other substrings that a line as long or shorter may have as a segment.

    A line of n characters has a budget of k edits and k + 1 segments, the shorter ones first; of any line within k edits one
    segment is unchanged. A key is length, place and content of a segment. Segment i of the other line can only have moved by i to
    either side seen from the left, and by k - i seen from the right.
    """
    sub = Substrings(lines)
    own, other = [], []
    for less in range(edits + 1):
        n = sub.n - less
        budget = np.minimum(edits, n // chars_per_edit)
        for most in range(max(1, less), edits + 1):
            rows = np.flatnonzero(budget == most)
            if not len(rows):
                continue
            length, parts = n[rows], most + 1
            base, short = length // parts, parts - length % parts
            for i in range(parts):
                start, size = base * i + np.maximum(0, i - short), base + (i >= short)
                for move in range(max(-i, less - (most - i)), min(i, less + most - i) + 1):
                    at = start + move
                    fits = (at >= 0) & (at + size <= sub.n[rows])
                    key = sub.of(rows[fits], at[fits], size[fits]) + (length[fits] * (edits + 1) + i).astype(np.uint64) * ODD[2]
                    (other if less or move else own).append((rows[fits], _mixed(key)))
    none = (np.empty(0, np.int64), np.empty(0, np.uint64))
    return tuple(tuple(map(np.concatenate, zip(*x, strict=True))) if x else none for x in (own, other))


def _set_bits(plane: np.ndarray, places: np.ndarray) -> None:
    """Sets bits of a packed plane; places ascend."""
    if len(places):
        at = places >> 3
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        plane[at[begin]] |= np.bitwise_or.reduceat((1 << (places & 7)).astype(np.uint8), begin)


def _has_bits(plane: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (plane[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _places(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


class Sieve:
    """Which hashed keys are a line's segment (once), two lines' (twice), or a substring that is looked up (looked).

    Its size is fixed. It may let a key pass that meets no other, never the other way round.
    """

    def __init__(self, planes: np.ndarray | None = None) -> None:
        self.planes = np.zeros((3, 1 << (SIEVE_BITS - 3)), np.uint8) if planes is None else planes

    def add(self, own: np.ndarray, other: np.ndarray) -> None:
        once, twice, looked = self.planes
        places, times = np.unique(_places(own), return_counts=True)
        _set_bits(twice, places[(times > 1) | _has_bits(once, places)])
        _set_bits(once, places)
        _set_bits(looked, np.unique(_places(other)))

    def parts(self) -> Iterator[tuple[int, bytes]]:
        for i, part in enumerate(np.split(self.planes, PARTS, axis=1)):
            if part.any():
                yield i, zlib.compress(part.tobytes(), 1)


def _merged(parts: DataFrame) -> Sieve:
    """One sieve of all partitions': 3 * 2**SIEVE_BITS bits, whatever the input's size. parts: (part, bits)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for bits in pdf["bits"]:
            now = np.frombuffer(zlib.decompress(bits), np.uint8).reshape(3, -1)
            total = now.copy() if total is None else np.stack([total[0] | now[0], total[1] | now[1] | total[0] & now[0], total[2] | now[2]])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [zlib.compress(total.tobytes(), 1)]})

    dealt = parts.select("part", "bits", F.pmod(F.xxhash64("bits"), F.lit(64)).alias("salt"))
    sieve = Sieve()
    slices = np.split(sieve.planes, PARTS, axis=1)
    for r in dealt.groupBy("part", "salt").applyInPandas(add, "part int, bits binary").groupBy("part").applyInPandas(add, "part int, bits binary").collect():
        slices[r.part][:] = np.frombuffer(zlib.decompress(r.bits), np.uint8).reshape(3, -1)
    return sieve


class _Fresh:
    """Lines that haven't been seen lately, gathered until they are worth working on."""

    most = 1 << 17

    def __init__(self) -> None:
        self.seen: set[int] = set()
        self.clear()

    def clear(self) -> None:
        self.lids: list[int] = []
        self.lines: list[str] = []
        self.chars = 0

    def offer(self, lid: int, line: str) -> None:
        if lid not in self.seen:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen.add(lid)
            self.lids.append(lid)
            self.lines.append(line)
            self.chars += len(line)


def _batch(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _scan(docs: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    """A row (doc_id, line_no, lid) per line, and at the end of each partition the parts of its sieve."""
    names, kinds = ["doc_id", "line_no", "lid", "part", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, fresh = Sieve(), _Fresh()

        def work() -> None:
            if fresh.lines:
                (_, own), (_, other) = keys(fresh.lines, edits, chars_per_edit)
                sieve.add(own, other)
                fresh.clear()

        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for no, line in lines_of(text or ""):
                    lid = line_id(line)
                    for c, v in zip(out, (doc_id, no, lid), strict=True):
                        c.append(v)
                    fresh.offer(lid, line)
                    if fresh.chars >= CHUNK:
                        work()
            none = [None] * len(out[0])
            yield _batch([*out, none, none], kinds, names)
        work()
        for part, bits in sieve.parts():
            yield _batch([[None], [None], [None], [part], [bits]], kinds, names)

    return docs.mapInArrow(run, "doc_id long, line_no int, lid long, part int, bits binary")


def _postings(docs: DataFrame, shared, edits: int, chars_per_edit: int) -> DataFrame:
    """(key, lid, home) of the keys that may meet another line's; home tells the line's own segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, meets, fresh = shared.value[0], shared.value[1] | shared.value[2], _Fresh()

        def work() -> Iterator[pa.RecordBatch]:
            if fresh.lines:
                lids = np.array(fresh.lids, np.int64)
                (r1, own), (r2, other) = keys(fresh.lines, edits, chars_per_edit)
                fresh.clear()
                k1, k2 = _has_bits(meets, _places(own)), _has_bits(once, _places(other))
                key = np.concatenate([own[k1], other[k2]]).view(np.int64)
                home = np.repeat([True, False], [k1.sum(), k2.sum()])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([lids[r1[k1]], lids[r2[k2]]])), pa.array(home)], names=["key", "lid", "home"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                for _, line in lines_of(text or ""):
                    fresh.offer(line_id(line), line)
                    if fresh.chars >= CHUNK:
                        yield from work()
        yield from work()

    return docs.mapInArrow(run, "key long, lid long, home boolean")


def _bins(lines: list[str]) -> np.ndarray:
    """Counts of characters by a hash of them, modulo 256, eight to a number."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    bin_of = (points.astype(np.uint64) * ODD[0] >> np.uint64(60)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lines)), n) * BINS + bin_of, minlength=len(lines) * BINS)
    return counts.astype(np.uint8).view(np.int64).reshape(len(lines), 2)


def _texts(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(lid, line, bins1, bins2) of the wanted lines (lid), and what its tasks share. A plane of bits tells most others while scanning; the join below decides."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve()
        for batch in batches:
            sieve.add(batch.column(0).to_numpy().view(np.uint64), np.empty(0, np.uint64))
        for part, bits in sieve.parts():
            yield _batch([[part], [bits]], [pa.int32(), pa.binary()], ["part", "bits"])

    shared = docs.sparkSession.sparkContext.broadcast(_merged(wanted.mapInArrow(mark, "part int, bits binary")).planes[0].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, fresh = shared.value, _Fresh()

        def work() -> Iterator[pa.RecordBatch]:
            if fresh.lines:
                bins = _bins(fresh.lines)
                yield _batch([fresh.lids, fresh.lines, bins[:, 0], bins[:, 1]], [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["lid", "line", "bins1", "bins2"])
                fresh.clear()

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = lines_of(text or "")
                lids = [line_id(line) for _, line in found]
                some = _has_bits(plane, _places(np.array(lids, np.int64).view(np.uint64)))
                for i in np.flatnonzero(some):
                    fresh.offer(lids[i], found[i][1])
                if fresh.chars >= CHUNK:
                    yield from work()
        yield from work()

    return docs.mapInArrow(run, "lid long, line string, bins1 long, bins2 long").join(wanted, "lid", "left_semi").dropDuplicates(["lid"]), shared


def _bins_allow(edits: int) -> Column:
    """An edit changes two counts by one at most; so it does to their remainders, seen in a circle."""
    apart = F.lit(0)
    for c in ("bins1", "bins2"):
        for i in range(8):
            x, y = (F.shiftright(F.col(f"{c}{s}"), 8 * i).bitwiseAND(255) for s in ("x", "y"))
            apart = apart + F.least(F.pmod(x - y, F.lit(256)), F.pmod(y - x, F.lit(256)))
    return apart <= 2 * edits


def _verified(pairs: DataFrame, lines: DataFrame, edits: int, chars_per_edit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [within(x, y, edit_budget(min(len(x), len(y)), edits, chars_per_edit)) for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(lines.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a")
    return one.join(lines.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def line_classes(docs: DataFrame, *, edits: int = 2, chars_per_edit: int = 10) -> DataFrame:
    """Every line of docs (doc_id, text) with its class: lines are linked if they are few edits apart.

    Two lines may be parted by an edit for every chars_per_edit characters of the shorter one, and by so many edits at most; shorter
    lines than chars_per_edit are linked only if equal. Lines are compared without blanks at their ends; blank ones are left out.

    Equal lines are one from the start. A line with a budget of k edits is cut into k + 1 segments, one of which every line within
    k edits holds unchanged; segments are filed by length, place and content, and each line looks up the substrings that may be such
    a segment. A first scan notes in bits which keys occur, so that the second one posts few that meet no other; only texts of
    lines that meet are read again. What meets is verified by banded bit-parallel edit distance: first with one line per file, then
    with those that are not in the same class yet and whose counts of characters allow it, so that neither many alike lines nor many
    variants of one line make all pairs.

    Edge cases: null and empty texts have no lines; repeated rows are lines of their own with the same doc_id; a null id ranks first;
    an empty table gives no rows; other columns are ignored. Equality of lines is that of a 64-bit hash.

    Returns doc_id, line_no (from 0), class_id, n_lines (of the class), first_doc_id, first_line_no, kept (the first of its class).
    """
    if edits < 0 or chars_per_edit < edits + 1:
        raise ValueError("edits must be 0 or more, chars_per_edit above it")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = stored(_scan(texts, edits, chars_per_edit), "lines-scan")
    rows = scan.where("part is null").select("doc_id", "line_no", "lid")
    shared = docs.sparkSession.sparkContext.broadcast(_merged(scan.where("part is not null").select("part", "bits")).planes)
    posted = stored(_postings(texts, shared, edits, chars_per_edit).groupBy("key", "lid").agg(F.max("home").alias("home")), "lines-posted")
    shared.destroy()  # the driver and each executor have a file of it
    filed = stored(posted.where("home").groupBy("key").agg(F.min("lid").alias("lead"), F.max("lid").alias("last")), "lines-filed")
    met = stored(posted.join(filed, "key").where("lead <> lid or last <> lid"), "lines-met")
    release(posted, filed)
    wanted = stored(met.select("lid").unionByName(met.select(F.col("lead").alias("lid"))).distinct(), "lines-wanted")
    found, shared = _texts(texts, wanted)
    lines = stored(found, "lines-texts")
    shared.destroy()
    led = stored(met.where("lead <> lid").select(F.least("lid", "lead").alias("a"), F.greatest("lid", "lead").alias("b")).distinct(), "lines-led")
    links = stored(_verified(led, lines, edits, chars_per_edit), "lines-links")
    release(wanted)
    parts = stored(components(links), "lines-parts")
    part = parts.withColumnRenamed("node", "lid")

    rooted = stored(met.where("lead <> last").select("key", "lid", "home").join(part, "lid", "left").withColumn("root", F.coalesce("root", "lid")), "lines-rooted")
    various = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    busy = stored(rooted.join(various, "key").join(lines.select("lid", "bins1", "bins2"), "lid"), "lines-busy")
    release(met, parts, rooted)
    x, y = (busy.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("lid", "root", "home", "bins1", "bins2")]) for s in ("x", "y"))
    rest = x.join(y.where("homey"), "key").where("rootx <> rooty").where("not homex or lidx < lidy").where(_bins_allow(edits))
    rest = rest.select(F.least("lidx", "lidy").alias("a"), F.greatest("lidx", "lidy").alias("b")).distinct()
    more = stored(_verified(rest.join(led, ["a", "b"], "left_anti"), lines, edits, chars_per_edit), "lines-more")
    release(busy, lines, led)
    classes = stored(components(links.unionByName(more)), "lines-classes")
    release(links, more)
    whole = classes.withColumnRenamed("node", "lid")

    # A line and a class may hold a third of all rows: they are counted before they meet in one task, and joined after they have been.
    own = rows.groupBy("lid").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    own = stored(own.join(whole, "lid", "left"), "lines-own")
    total = stored(own.where("root is not null").groupBy("root").agg(F.min("first").alias("low"), F.sum("n").alias("n_lines")), "lines-totals")
    known = own.join(total, "root", "left").select("lid", F.coalesce("root", "lid").alias("class_id"), F.coalesce("n_lines", "n").alias("n_lines"), F.coalesce("low", "first").alias("first"))
    known = stored(known, "lines-known")
    release(own, total, classes)
    return rows.join(known, "lid").select(
        "doc_id", "line_no", "class_id", "n_lines", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )
