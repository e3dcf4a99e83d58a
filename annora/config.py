"""Settings of an index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexConfig:
    """The defaults up to insert_ratio_threshold. shard_rows bounds what one task holds of an index.

    cells: 0 deals rows to shards by id, and a search visits all of them. A number deals them by their nearest of so many coarse centres,
    fitted on 64 vectors per cell; a vector whose second nearest centre is at most boundary times as far (by squared distance) is in that cell, too,
    and a search visits the probes nearest cells of a query. The centres are kept in each version's record.
    verify: a search by the graph is followed by an exact check of the shards it looks into, which adds what it missed: exact where all of them are looked into.
    max_folders: how many data folders a version has at most before an insert merges the smaller ones.
    """

    max_degree: int = 64
    search_list: int = 128
    build_passes: int = 2
    ef_search: int = 128
    rerank_top_n: int = 500
    exact_up_to: int = 50_000
    alpha: float = 1.2
    drift_threshold: float = 0.05
    insert_ratio_threshold: float = 0.30
    shard_rows: int = 20_000
    seed: int = 42
    cells: int = 0
    probes: int = 8
    boundary: float = 1.5
    max_folders: int = 16
    verify: bool = False

    def __post_init__(self) -> None:
        if min(self.max_degree, self.search_list, self.ef_search, self.rerank_top_n, self.shard_rows, self.probes, self.max_folders) < 1 or min(self.build_passes, self.cells) < 0 or min(self.alpha, self.boundary) < 1:
            raise ValueError("degrees, list sizes, shard_rows, probes and max_folders must be 1 or more, alpha and boundary too")

    def beam(self, k: int) -> tuple[int, int]:
        """How many candidates are re-ranked, and how wide the beam is."""
        rerank = max(self.rerank_top_n, 3 * k)
        return rerank, max(self.ef_search, rerank)
