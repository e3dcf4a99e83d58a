"""Which shard a vector is in, and which shards a search looks into."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annora.functions import kernels
from annora.operators.knn import matrix_of

#: Vectors that the centres are fitted on, per cell.
PER_CELL = 64


def shards_for(rows: int, shard_rows: int) -> int:
    """So many that the largest is expected to hold shard_rows at most: dealing to a number that isn't a power of two leaves some twice as full as others."""
    return 1 if rows <= shard_rows else math.ceil(2 * rows / shard_rows)


def _level(shards: int) -> int:
    return 1 << (shards.bit_length() - 1)


def shard_of(id_col: Column, shards: int) -> Column:
    """Linear hashing: one more shard takes rows from a single one."""
    return _hashed(id_col, F.lit(shards), F.lit(_level(shards)))


def _hashed(id_col: Column, shards: Column, low: Column) -> Column:
    r = F.pmod(F.xxhash64(id_col), 2 * low).cast("int")
    return F.when(r < shards, r).otherwise(r - low)


def split_shards(old: int, new: int) -> dict[int, set[int]]:
    """Which of the old shards give rows to which new ones when their number grows."""
    out: dict[int, set[int]] = {}
    for shard in range(old, new):
        parent = shard
        while parent >= old:
            parent -= _level(parent)
        out.setdefault(parent, set()).add(shard)
    return out


def fit_centres(vectors: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centres of cells groups, fitted on a seeded sample of PER_CELL * cells rows (id, vector) at most; copies of one vector count once."""
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(PER_CELL * cells).select("vector")
    table = some.toArrow()
    return kernels.coarse_centres(matrix_of(table["vector"].combine_chunks()).astype(np.float32), cells, seed)


@dataclass(frozen=True)
class Layout:
    """How nodes are dealt: cell c has subs[c] shards, numbered c, c + cells, c + 2 * cells and so on; which of them, a hash of the id tells.

    So a cell that holds very many vectors, or copies of one vector, is still dealt to shards of bounded size. Without centres there is one cell.
    """

    subs: tuple[int, ...]
    centres: np.ndarray | None = None
    boundary: float = 1.0

    @staticmethod
    def of(meta) -> Layout:
        return Layout(tuple(meta.subs), np.array(meta.cells, np.float32) if meta.cells else None, meta.boundary)

    @property
    def cells(self) -> int:
        return len(self.subs)

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """(cell, id, vector, copy) of vectors (id, vector): one row for the nearest centre and, near the boundary to another, one for that: a copy."""
        if self.centres is None:
            return vectors.select(F.lit(0).alias("cell"), "id", "vector", F.lit(False).alias("copy"))
        centres, boundary = self.centres, self.boundary

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                cell, far = kernels.nearest_centres(matrix_of(batch.column(1)), centres, 2)
                own = np.arange(len(batch))
                for rank in range(cell.shape[1]):
                    at = own if rank == 0 else own[far[:, 1] <= boundary * far[:, 0]]
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at, rank].astype(np.int32)), *part.columns, pa.array(np.full(len(at), rank > 0))], names=["cell", "id", "vector", "copy"])

        return vectors.select("id", "vector").mapInArrow(work, "cell int, id long, vector array<float>, copy boolean")

    def shard(self, cell: Column, id_col: Column) -> Column:
        if self.cells == 1:
            return shard_of(id_col, self.subs[0])
        subs, lows = (F.get(F.array(*(F.lit(x) for x in values)), cell) for values in (self.subs, [_level(s) for s in self.subs]))
        return _hashed(id_col, subs, lows) * self.cells + cell

    def shards(self, cells: set[int]) -> set[int]:
        return {sub * self.cells + c for c in cells for sub in range(self.subs[c])}

    def grown(self, rows: list[int], shard_rows: int) -> tuple[Layout, dict[int, set[int]]]:
        """The layout for so many rows of each cell, none of which gets fewer shards, and which shards give rows to which new ones."""
        subs = tuple(max(old, shards_for(n, shard_rows)) for old, n in zip(self.subs, rows, strict=True))
        split = {}
        for c, (old, new) in enumerate(zip(self.subs, subs, strict=True)):
            split |= {p * self.cells + c: {s * self.cells + c for s in children} for p, children in split_shards(old, new).items()}
        return Layout(subs, self.centres, self.boundary), split

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray | None:
        """For each query the cells to look into, nearest first; None: all."""
        return None if self.centres is None else kernels.nearest_centres(queries, self.centres, probes)[0]
