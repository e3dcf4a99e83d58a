"""Periodic run detection: an online dynamic program over the sparse diagonals of a text's words against themselves."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from annora.llm.common import bounded_batches


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _repeated(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of the keys that occur more than once, by number and start, which ascends; numbers are dense."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    group = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(ranked) else ranked
    many = np.bincount(group)[group] > 1 if len(ranked) else np.empty(0, bool)
    number = np.unique(group[many], return_inverse=True)[1]
    return number, start[order[many]]


def occurrences(numbers: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(word, lag, length): earlier occurrences that the diagonals of runs are made of, by word.

    A run of period q matches itself at lag q over at least max(least, times * q) - q words. For each length L (the largest power of
    two that every run's match has, and its doubles) only words count whose last L words occurred before, and of these occurrences only
    the latest, at a lag from L / 2 to L (up to L for the first). That loses no run: an occurrence at a lag p below q would give a
    stretch of p + L >= p + q words both periods, and so (Fine and Wilf) the run a period below q. Where a word has many earlier
    occurrences, one per length is looked at, so that the work is n log n for any text.
    """
    n, size, found = len(numbers), 1, []
    first = 1 << (_least_match(least, times).bit_length() - 1)
    number, start = _repeated(numbers, np.arange(n))
    place = np.full(n, -1, np.int64)
    while len(number) and (size <= first or times * (size // 2) < n):
        if size >= first:
            lag = np.diff(start)
            fine = (np.diff(number) == 0) & (lag <= size) & ((lag > size // 2) if size > first else True)
            at = start[1:][fine] + size - 1
            found += zip(at.tolist(), lag[fine].tolist(), [size] * len(at), strict=True)
        place[:] = -1
        place[start] = number
        own = start + 2 * size <= n
        start, number = start[own], number[own]
        after = place[start + size]
        own = after >= 0
        number, start = _repeated(number[own] * (n + 1) + after[own], start[own])
        size *= 2
    found.sort()
    return found


def _least_match(least: int, times: int) -> int:
    """The fewest words that a run matches itself over at the lag of its period: max(least, times * q) - q is least where the two meet."""
    q = least // times
    return min(max(least, times * x) - x for x in (max(1, q), q + 1))


def runs_of(numbers: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    Goes through the words once. An earlier occurrence of a word lengthens the match at its lag, if one is active, or begins one; a
    lag that the word doesn't continue has ended, and is a run if it is long enough.
    """
    out: list[tuple[int, int, int]] = []

    def end(lag: int, match: int, last: int) -> None:
        if match + lag >= max(least, times * lag):
            out.append((last - match - lag + 1, match + lag, lag))

    active: dict[int, int] = {}
    last = -2
    for word, met in groupby(occurrences(numbers, least, times), itemgetter(0)):
        if word != last + 1:
            for lag, match in active.items():
                end(lag, match, last)
            active = {}
        now = {lag: active[lag] + 1 if lag in active else size for _, lag, size in met}
        for lag in active.keys() - now.keys():
            end(lag, active[lag], last)
        active, last = now, word
    for lag, match in active.items():
        end(lag, match, last)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that any run has after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start and period) and its collapsed text.

    Words are runs of bytes other than space and U+0009 to U+000D, numbered from 0. A run is a stretch of words with smallest period q
    (words q apart are equal) of max(least, times * q) words or more, that no neighbouring word continues; times is 3 or more. In
    collapsed a word is dropped if a run has it after its first q words; the others are joined by one space.

    A text that is null or holds no words has no runs and an empty collapsed text. Rows that share an id, or have none, stay rows of
    their own; columns other than doc_id and text are left out. A text is one task's work, in time n log n of its words.
    """
    if times < 3 or least < times:
        raise ValueError("times must be 3 or more, and least at least as many")
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                found = runs_of(word_numbers(words), least, times) if len(words) >= least else []
                counts.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                texts.append(collapsed(words, found))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    made = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return rows.mapInArrow(work, StructType([docs.schema["doc_id"], *made]))
