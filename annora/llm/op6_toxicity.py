"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annora.llm.common import bounded_batches, stored

# Look-alikes of Latin letters in Greek and Cyrillic, and digits and signs used for letters. i, l, 1 and | are one class.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "i", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e"}
#: Phrases in which a listed word isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "pond scum", "stupid simple")
PREFIXES = (3, 4, 5, 6)


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0xA0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        table[c] = base if "a" <= base <= "z" else chr(c).lower()
    for c in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF):
        table[c] = None  # combining marks and invisible characters
    for c in range(0xFF01, 0xFF5F):
        table[c] = chr(c - 0xFEE0).lower()
    for c in range(65, 91):
        table[c] = chr(c + 32)
    for k, v in HOMOGLYPHS.items():
        table[ord(k)] = table[ord(k.upper()[0])] = v
    for c, v in list(table.items()):
        table[c] = SUBSTITUTES.get(v, v) if v else v
    table.update({ord(k): v for k, v in SUBSTITUTES.items()})
    table[ord("L")] = table[ord("I")] = "i"
    return table


FOLD = _fold_table()
#: Runs between words; what folding leaves of digits and signs inside a word is part of it.
BETWEEN = re.compile(r"[^\w]+")


def folded(text: str) -> str:
    """Words of the text, folded and parted by single spaces, with a space before the first and after the last.

    A sign that stands for a letter counts as one only inside or before a word; at its end (as in "trash!") it is punctuation.
    """
    return f" {BETWEEN.sub(' ', re.sub(r'[!|$@€]+(?=\s|$)', ' ', text).translate(FOLD)).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries start with a space (a word's beginning) and end with one if they are whole words; score = 1 / (1 + exp(-(slope * x + offset)))."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    offset: float

    def matcher(self) -> Callable[[str | None], float]:
        """text -> weight of its matches per 100 words, on a log scale."""
        auto = ahocorasick.Automaton()
        for entry, weight in self.entries:
            auto.add_word(entry, (weight, len(entry)))
        for phrase in self.exceptions:
            auto.add_word(folded(phrase), (None, len(folded(phrase))))
        if len(auto):
            auto.make_automaton()

        def density(text: str | None) -> float:
            if not text or not len(auto):
                return 0.0
            body = folded(text)
            found: dict[int, float] = {}
            spared: list[tuple[int, int]] = []
            for end, (weight, length) in auto.iter(body):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
            for a, b in spared:
                for start in [s for s in found if a <= s < b]:
                    del found[start]
            return math.log1p(100.0 * math.fsum(found.values()) / max(1, body.count(" ") - 1))

        return density

    def score(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.offset))))


def _beginnings(text: str) -> set[str]:
    """What of each word could be an entry: the word as a whole, and its first letters."""
    words = set(folded(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, min_docs: int = 5, min_share: float = 0.01, purity: float = 0.9, exceptions: tuple[str, ...] = EXCEPTIONS, seed: int = 5) -> Lexicon:
    """A lexicon learned from labels (doc_id, toxic 0/1) and the texts of docs (doc_id, text).

    Fitted on max_rows labelled documents at most (a seeded sample, which bounds what is broadcast and what the driver gathers; as an
    entry takes a share of the toxic ones, there are no more entries than 1 / min_share times a document's words). Equal texts
    count once, or the words of a copied document would look toxic; if their labels contradict each other, not at all. An entry is a word or a word's
    beginning that occurs in min_docs toxic documents and in min_share of them at least, while purity or more of all documents that
    hold it are toxic; its weight is the log of the odds, each class counting the same. Beginnings that a shorter
    entry covers as well are left out. A one-variable logistic regression turns the matched weight into a score.

    Labels that are null or contradict each other are left out. With one class or none, every score is that of its share.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2"))
        .where("y = y2")
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")
    train = train.groupBy("text").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("text", "y")
    train = stored(train, "toxicity-train")
    clean, toxic = train.agg(F.count_if(F.col("y") <= 0), F.count_if(F.col("y") > 0)).first()
    if not clean or not toxic:
        share = (toxic + 1) / (clean + toxic + 2)
        return Lexicon((), exceptions, 0.0, math.log(share / (1 - share)))
    support = max(min_docs, math.ceil(min_share * toxic))

    def counted(wanted: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(_beginnings(text) if wanted is None else _beginnings(text) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])

        return run

    def counts(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
        return rows.select("text").mapInArrow(counted(wanted), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    found = {r.entry: r.n for r in counts(train.where("y > 0"), None).where(F.col("n") >= support).collect()}
    wanted = set(found)

    whole = {r.entry: r.n for r in counts(train.where("y <= 0"), wanted).collect()}
    entries: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        p, n = (found[entry] + 0.1) / (toxic + 0.2), (whole.get(entry, 0) + 0.1) / (clean + 0.2)
        if p / (p + n) >= purity and whole.get(entry, 0) <= (1 - purity) * (whole.get(entry, 0) + found[entry]):
            weight = math.log(p / n)
            shorter = max((entries.get(entry[:k], 0.0) for k in range(2, len(entry))), default=0.0)
            if weight > shorter + 0.5:
                entries[entry] = weight
    best = tuple(sorted(entries.items()))
    start = Lexicon(best, exceptions, 0.0, 0.0)
    scored = sorted((r.x, r.y) for r in densities(train, start).collect())
    slope, offset = _logistic([x for x, _ in scored], [y for _, y in scored])
    return Lexicon(best, exceptions, slope, offset)


def densities(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        density = lexicon.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([density(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "y"])

    return rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "x double, y int")


def _logistic(x: Iterable[float], y: Iterable[int], ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method; the ridge keeps classes that can be told apart without error finite."""
    a = np.stack([np.asarray(x, float), np.ones(len(list(y)))], 1)
    t, w = (np.asarray(y) > 0).astype(float), np.zeros(2)
    weight = np.where(t > 0, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1)) * len(t)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - t)) + ridge * len(t) * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(t) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of docs, with tox_score (0 to 1) of the whole text, which replaces a column so named; null and empty texts score as texts without a match do.

    Rows are scored one by one, so that repeated rows, equal texts and null ids each keep theirs; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        density = lexicon.matcher()
        for batch in batches:
            scores = pa.array([lexicon.score(density(t)) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "tox_score"])

    bounded_batches(docs.sparkSession)
    rows = docs.drop("tox_score")
    at = [c.lower() for c in rows.columns].index("text")
    return rows.mapInArrow(run, StructType(list(rows.schema)).add("tox_score", "double"))


def training_labels(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """labels without the fifth that is held out: rows whose crc32(doc_id as text) mod 5 is 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; the lexicon is fitted on labels that aren't held out.

    A null doc_id is held out of nothing: its held_out is false.
    """
    lexicon = fit_lexicon(docs, training_labels(docs.sparkSession, labels))
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    slim = score_toxicity(rows.select("doc_id", "held_out", "text"), lexicon)
    return slim.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
