"""Aggregates over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annora.functions.columns import l2sq, minus, sq_norm
from annora.operators.knn import matrix_of


SUMS = "n long, total array<double>"


def vector_sums(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row (n, total): how many vectors there are (nulls left out), and the sum of each element, added up in double.

    Each partition gives one row, which is all that is shuffled; the task that adds them up holds a batch of them at a time.
    """

    def added(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0)
        for more, part in parts:
            n, total = n + more, part if not len(total) else total + part if len(part) else total
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["n", "total"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added((len(x), matrix_of(x.column(0)).sum(0)) for x in batches if len(x))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added((n, np.array(total, float)) for x in batches for n, total in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))

    rows = vectors.where(F.col(vec_col).isNotNull()).select(vec_col)
    return rows.mapInArrow(partial, SUMS).repartition(1).mapInArrow(merged, SUMS)


def centroid(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row (n, centroid): the element-wise mean as float; none (an empty array) without vectors."""
    return vector_sums(vectors, vec_col).select("n", F.transform("total", lambda x: (x / F.col("n")).cast("float")).alias("centroid"))


def medoid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The row nearest to the mean, ties to the smaller id."""
    c = F.broadcast(centroid(vectors, vec_col).select("centroid"))
    near = vectors.join(c).select(F.col(id_col), l2sq(F.col(vec_col), F.col("centroid")).alias("score"))
    return near.orderBy("score", id_col).limit(1)


def drift(now: Column, built: Column) -> Column:
    """How far the mean has moved, relative to the norm of the mean at build time."""
    norm = F.sqrt(sq_norm(F.transform(built, lambda x: x.cast("double"))))
    return F.when(norm == 0, 0.0).otherwise(F.sqrt(sq_norm(minus(now, built))) / norm)
