"""Language identification by a convolutional network over bytes, trained and applied in NumPy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annora.llm.common import bounded_batches, stored

#: Bytes of a window, widths of the filters and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: What follows a window's last byte, so that no filter's place is lost between two windows.
STRIDE = WINDOW - max(WIDTHS) + 1
#: Windows that a task looks at together.
TOGETHER = 64
UNKNOWN = "und"
#: Numbers that texts draw.
DRAWS = 1_000_003


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the whole texts, padded with zeros, and which text each is of; an empty text has one of zeros."""
    count = [max(1, -(-(len(t) - WINDOW + STRIDE) // STRIDE)) for t in texts]
    size = [(c - 1) * STRIDE + WINDOW for c in count]
    flat = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, size, strict=True)), np.uint8)
    of = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(np.cumsum([0, *size[:-1]]), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum([0, *count[:-1]]), count)
    return sliding_window_view(flat, WINDOW)[first + place * STRIDE], of


@dataclass(frozen=True)
class ByteNet:
    """taps[i]: for width WIDTHS[i] a table (place in the filter, byte, filter) of what a byte adds there, which is the filter over one-hot bytes.

    The largest sum over a window's places, with its bias, cut at 0, is the filter's answer; dense and offset turn the answers into one
    value per language, and softmax these into probabilities.
    """

    languages: tuple[str, ...]
    taps: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def answers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest sum in each window, and where it is."""
        best, at = [], []
        for taps in self.taps:
            width = len(taps)
            total = sum(taps[j][x[:, j : WINDOW - width + 1 + j]] for j in range(width))
            place = total.argmax(1)
            at.append(place)
            best.append(np.take_along_axis(total, place[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(at, 1)

    def scorer(self):
        """windows -> probabilities; the same as answers() and head(), by tables over pairs of bytes."""
        pairs = [[(t[j][:, None] + t[j + 1][None]).reshape(1 << 16, -1) for j in range(0, len(t) - 1, 2)] for t in self.taps]

        def probabilities(x: np.ndarray) -> np.ndarray:
            two = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
            best = []
            for taps, tables in zip(self.taps, pairs, strict=True):
                width = len(taps)
                places = WINDOW - width + 1
                total = tables[0].take(two[:, :places], 0)
                for i, t in enumerate(tables[1:], 1):
                    total += t.take(two[:, 2 * i : 2 * i + places], 0)
                if width % 2:
                    total += taps[-1].take(x[:, width - 1 : width - 1 + places], 0)
                best.append(total.max(1))
            return softmax(self.head(np.concatenate(best, 1)))

        return probabilities

    def head(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.dense + self.offset


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], *, epochs: int = 6, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 12) -> ByteNet:
    """A network fitted to windows x and their languages' places y by Adam; each language weighs the same.

    The largest sum of a filter is taken at one place of a window, so that only the bytes there get a gradient.
    """
    rng = np.random.default_rng(seed)
    taps = tuple(rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS)
    n = FILTERS * len(WIDTHS)
    net = ByteNet(languages, taps, np.zeros(n, np.float32), rng.normal(0, 1 / math.sqrt(n), (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    values = [*net.taps, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    weight = (len(y) / (len(languages) * np.maximum(1, np.bincount(y, minlength=len(languages))))).astype(np.float32)
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            part, want = x[rows], y[rows]
            best, at = net.answers(part)
            active = np.maximum(best + net.bias, 0)
            wrong = softmax(active @ net.dense + net.offset)
            wrong[np.arange(len(rows)), want] -= 1
            wrong *= (weight[want] / len(rows))[:, None]
            back = (wrong @ net.dense.T) * (active > 0)
            grads = [np.zeros_like(t) for t in net.taps]
            for i, (width, grad) in enumerate(zip(WIDTHS, grads, strict=True)):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                for j in range(width):
                    met = np.take_along_axis(part, at[:, own] + j, 1)
                    np.add.at(grad[j], (met, np.arange(FILTERS)[None]), back[:, own])
            grads += [back.sum(0), active.T @ wrong, wrong.sum(0)]
            step += 1
            pace = rate * (1 - 0.9 * step / steps) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= pace * (m / (np.sqrt(s) + 1e-8) + decay * v)
    return net


def samples(docs: DataFrame, *, per_language: int, seed: int) -> DataFrame:
    """(lang, x): two windows of each of per_language documents of each language at most, and beginnings of them that are shorter; equal texts count once.

    A hash of the text draws three times as many rows, of which copies go first, so that what is ranked doesn't grow with the table. What is
    broadcast is a row per language, as many as the network has outputs.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng([seed, h & 0xFFFFFFFF])
                for _ in range(2):
                    at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
                    part = text[at : at + WINDOW]
                    short = part[: int(WINDOW ** rng.uniform(0.3, 1))]
                    langs += [lang, lang]
                    windows += [part.ljust(WINDOW, b"\0"), short.ljust(WINDOW, b"\0")]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "x"])

    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    rows = known.groupBy("lang").agg(F.count("*").alias("rows"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(DRAWS))
    some = known.join(F.broadcast(rows), "lang").where(drawn * F.col("rows") < DRAWS * 3 * per_language).where(has_letter(F.col("text")))
    once = some.groupBy("lang", F.xxhash64(F.lit(seed + 1), "text").alias("h")).agg(F.min("text").alias("text"))
    few = once.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= per_language)
    return few.select("lang", F.col("text").cast("binary").alias("text"), "h").mapInArrow(cut, "lang string, x binary")


def has_letter(text: Column) -> Column:
    """Whether any character is a letter; false for null."""
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def fit_languages(docs: DataFrame, *, per_language: int = 1000, seed: int = 12) -> ByteNet | None:
    """A network that tells the values of docs.lang from docs.text.

    Fitted on the texts of per_language documents of each language at most (a seeded sample; 4 windows of WINDOW bytes each are what
    the driver gathers). Rows whose lang is null or whose text has no letter teach nothing. None without any; with one language,
    that is what every text gets.
    """
    rows = sorted((r.lang, bytes(r.x)) for r in stored(samples(docs, per_language=per_language, seed=seed), "language-samples").toLocalIterator())
    if not rows:
        return None
    languages = tuple(sorted({lang for lang, _ in rows}))
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), WINDOW)
    return train(x, np.array([place[lang] for lang, _ in rows]), languages)


def predict_languages(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """All columns of docs, with lang_pred and lang_score (0 to 1), which replace columns so named.

    The whole text counts: it is cut into windows of WINDOW bytes, whose probabilities are averaged by their bytes; the language with the
    largest mean is the prediction (ties: the first by name), the mean its score. A text that is null or has no letter is 'und' with score 0, and so is every text
    where there is no network. A task holds the probabilities of TOGETHER windows at a time, and one sum per text of a batch.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "lang_score")
    at = [c.lower() for c in rows.columns].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            told: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            asked = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t or ""))]
            if asked:
                total = np.zeros((len(asked), len(net.languages)))
                x, of = windows_of([texts[i].encode() for i in asked])
                for a in range(0, len(x), TOGETHER):
                    part = x[a : a + TOGETHER]
                    np.add.at(total, of[a : a + TOGETHER], score(part) * np.count_nonzero(part, axis=1)[:, None])
                total /= total.sum(1, keepdims=True)
                for i, best, p in zip(asked, total.argmax(1).tolist(), total.max(1).tolist(), strict=True):
                    told[i] = net.languages[best], min(1.0, p)
            columns = [*batch.columns, pa.array([p for p, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "lang_score"])

    return rows.mapInArrow(work, StructType(list(rows.schema)).add("lang_pred", "string").add("lang_score", "double"))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs; the network is fitted on rows whose crc32(doc_id as text) mod 5 is not 0.

    A row without an id is neither held out nor learned from.
    """
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = fit_languages(docs.where(~fifth))
    told = predict_languages(docs.select("doc_id", F.coalesce(fifth, F.lit(False)).alias("held_out"), "text"), net)
    return told.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
