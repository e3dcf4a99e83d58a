"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annora.llm.common import bounded_batches

BETWEEN, WORD = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+")
HITS = "doc_id long, item_id long, distance int, item_chars int, start int, end int"


def normalised(text: str) -> str:
    """Letters and digits in lower case, runs of anything else as one space."""
    return BETWEEN.sub(" ", text).strip().lower()


def edit_budget(chars: int, rate: float) -> int:
    return int(chars * rate)


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the place in text that matches pattern with fewest edits, the first if several do; Myers' bit-parallel algorithm."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


@dataclass
class Matcher:
    """Items (id, text) to be found in texts with at most rate edits per character of the normalised item.

    Items and texts are put between spaces, so that an item is found as whole words: one too short for an edit is in no longer word.
    """

    items: list[tuple[int, str]]
    rate: float
    bodies: list[tuple[int, str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in self.items:
            body = normalised(text or "")
            if not body:
                continue
            k = edit_budget(len(body), self.rate)
            body = f" {body} "
            self.bodies.append((item_id, body, k))
            cuts = [i * len(body) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(body[a:b], []).append((len(self.bodies) - 1, a))
        self.auto = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), where))
        if pieces:
            self.auto.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, item_chars, start, end) of the best place of each item that is in text, in code points of text."""
        if not text or not self.bodies:
            return []
        body = f" {normalised(text)} "
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.auto.iter(body):
            for item, offset in where:
                starts.setdefault(item, set()).add(end - length + 1 - offset)
        found = []
        for item, at in sorted(starts.items()):
            item_id, pattern, k = self.bodies[item]
            best = None
            for lo, hi in self._windows(sorted(at), len(pattern), k, len(body)):
                exact = body.find(pattern, lo, hi)
                if exact >= 0:
                    best = (0, exact, exact + len(pattern))
                    break
                distance, end = best_end(pattern, body[lo:hi])
                if distance <= k and (best is None or distance < best[0]):
                    _, length = best_end(pattern[::-1], body[lo : lo + end][::-1])
                    best = (distance, lo + end - length, lo + end)
            if best:
                found.append((item_id, best[0], len(pattern) - 2, *self._original(text, best[1] - 1, best[2] - 1)))
                if first_only:
                    break
        return found

    @staticmethod
    def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
        """Stretches of the text in which the item must lie; overlapping ones are one."""
        lo = hi = None
        for s in starts:
            a, b = max(0, s - k), min(n, s + m + k)
            if hi is not None and a <= hi:
                hi = max(hi, b)
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = a, b
        if hi is not None:
            yield lo, hi

    @staticmethod
    def _original(text: str, start: int, end: int) -> tuple[int, int]:
        """Where the words that touch start to end of the normalised text are in text."""
        at, first, last = 0, None, 0
        for w in WORD.finditer(text):
            stop = at + len(w[0].lower())
            if stop > start and at < end:
                first = w.start() if first is None else first
                last = w.end()
            elif at >= end:
                break
            at = stop + 1
        return first or 0, last


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in blocks of bounded size, streamed from the cluster."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows: Iterable = items.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator()
    for item_id, text in rows:
        block.append((item_id, text))
        chars += len(text)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, *, rate: float = 0.05, block_chars: int = 4 << 20) -> DataFrame:
    """Every item (item_id, text) found in a document (doc_id, text) with at most floor(rate * its length) edits.

    Texts are compared in lower case, letters and digits only, runs of anything else as one space. An item of m characters with a
    budget of k edits is split into k + 1 pieces; wherever it occurs with k edits, one piece occurs unchanged. An Aho-Corasick
    automaton finds the pieces in one scan; Myers' algorithm verifies the stretch around each hit. Documents aren't shuffled. Items
    are the stated query set; they go to the executors in blocks of block_chars, each block in a scan of its own.

    Edge cases: null, empty and wordless items match nothing; null and empty texts hold nothing; equal items are reported each;
    a null id is reported as null; repeated rows are reported each; other columns are ignored.

    Returns doc_id, item_id, distance, item_chars, start, end (code points of the original text), one row per document row and item.
    """
    bounded_batches(docs.sparkSession)
    sc, found = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in item_blocks(items, block_chars):
        part = rows.mapInArrow(_finder(sc.broadcast(block), rate), HITS)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def _finder(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        names = ["doc_id", "item_id", "distance", "item_chars", "start", "end"]
        for batch in batches:
            out = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(t)]
            if out:
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, *, rate: float = 0.05, block_chars: int = 4 << 20) -> DataFrame:
    """docs, all columns, without the rows that find_leaks() would report. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(items, block_chars):
        docs = docs.mapInArrow(_keeper(sc.broadcast(block), rate, docs.columns.index("text")), docs.schema)
    return docs


def _keeper(shared, rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.matches(t, first_only=True) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run
