"""VectorIndex: build, search, insert and rebuild, as versions of a Parquet store."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annora.config import IndexConfig
from annora.operators.graph import build_nodes, checked, graph_join, graph_search, insert_nodes, last_writes, with_neighbours
from annora.operators.knn import knn_exact, knn_join
from annora.operators.quantize import reranked
from annora.operators.routing import Layout, fit_centres
from annora.operators.stats import vector_sums
from annora.sources.store import Conflict, IndexStore, Meta

TRIES = 20
#: Bytes of queries, and of what is kept of them, that a search by graph sends to all tasks.
BROADCAST = 32 << 20


@dataclass(frozen=True)
class Tracker:
    """The mean of an index, at build and now, and its counters."""

    built: np.ndarray
    total: np.ndarray
    count: int
    build_count: int

    @property
    def current(self) -> np.ndarray:
        return self.total / self.count if self.count else self.built

    @property
    def inserts_since(self) -> int:
        return max(0, self.count - self.build_count)

    @property
    def drift(self) -> float:
        norm = float(np.linalg.norm(self.built))
        return float(np.linalg.norm(self.current.astype(np.float32).astype(float) - self.built)) / norm if norm else 0.0

    def add(self, vectors: np.ndarray) -> Tracker:
        return replace(self, total=self.total + vectors.astype(float).sum(0), count=self.count + len(vectors))

    def reset(self) -> Tracker:
        """The mean of now as that of the build."""
        return replace(self, built=self.current, build_count=self.count)

    def needs_rebuild(self, cfg: IndexConfig) -> bool:
        return self.build_count > 0 and (self.drift > cfg.drift_threshold or self.inserts_since / self.build_count > cfg.insert_ratio_threshold)


class Rebuild:
    """A build that goes on in the background."""

    def __init__(self, index: VectorIndex, vectors: DataFrame) -> None:
        self._sc, self._group = index.spark.sparkContext, f"rebuild-{uuid.uuid4().hex}"
        pool = ThreadPoolExecutor(1)
        self.future: Future = pool.submit(self._run, index, vectors)
        pool.shutdown(wait=False)

    def _run(self, index: VectorIndex, vectors: DataFrame) -> None:
        self._sc.setJobGroup(self._group, "rebuild", interruptOnCancel=True)
        index.build(vectors)

    def cancel(self) -> None:
        """Stops its jobs; nothing is committed, and result() raises."""
        self._sc.cancelJobGroup(self._group)

    def done(self) -> bool:
        return self.future.done()

    def result(self, timeout: float | None = None) -> None:
        return self.future.result(timeout)


def _sums(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """How many vectors, and the sum of each element."""
    n, total = vector_sums(rows, "vector").first()
    return n, np.array(total, float) if n else np.zeros(dim)


#: The vectors of nodes, each once.
HOME = "not copy"


class VectorIndex:
    """An index at path. Readers see the newest committed version; a failed build or insert leaves the one before.

    Writers may work at the same time. An insert that finds another version committed meanwhile is done again on top of it. A build
    holds exactly its vectors; what was inserted while it ran is inserted again after it. Nodes are the vectors, and copies of those near a
    boundary between cells, where there are cells (`IndexConfig`).
    """

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None, *, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        self.spark, self.store, self.cfg, self.id_col, self.vec_col = spark, IndexStore(spark, path), config or IndexConfig(), id_col, vec_col
        self._warm: tuple[dict[int, str], DataFrame] | None = None

    def _newest(self) -> tuple[int, Meta]:
        last, meta = self.store.newest()
        if meta is None:
            raise RuntimeError("the index isn't built")
        return last, meta

    def nodes(self) -> DataFrame:
        return self._scan(self._newest()[1])

    def _scan(self, meta: Meta, shards: set[int] | None = None) -> DataFrame:
        """Nodes of some shards (of all, if not given): of those that are warm from memory, and no file of these is read."""
        live = {s: f for f, own in meta.folders.items() for s in own if shards is None or s in shards}
        warm = {s for s, f in live.items() if self._warm and self._warm[0].get(s) == f}
        if not warm:
            return self.store.nodes(meta, shards)
        held = self._warm[1].where(F.col("shard").isin(sorted(warm)))
        return held if len(warm) == len(live) else held.unionByName(self.store.nodes(meta, set(live) - warm))

    def meta(self) -> Meta:
        return self._newest()[1]

    def count(self) -> int:
        meta = self.store.newest()[1]
        return meta.node_count if meta else 0

    def max_node_id(self) -> int:
        """The largest node id that was given, or -1. Ids are unique in the index and stay with their node; a replaced node gets a new one."""
        meta = self.store.newest()[1]
        return meta.next_id - 1 if meta else -1

    def lookup(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        """Nodes of these vector ids (a list, or a table whose first column has them); where ids deal, only their shards' files are read."""
        meta = self.meta()
        layout = Layout.of(meta)
        table = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        asked = table.select(F.col(table.columns[0]).cast("long").alias("id")).distinct()
        shards = None
        if layout.cells == 1:
            shards = {r.s for r in asked.select(layout.shard(F.lit(0), F.col("id")).alias("s")).distinct().collect()}
        found = self._scan(meta, shards).where(HOME)
        return found.join(asked, "id", "left_semi").select(*found.columns)

    def lookup_nodes(self, node_ids: Sequence[int]) -> DataFrame:
        """Nodes of these node ids; files are told apart by their least and largest one."""
        return self.nodes().where(F.col("node_id").isin([int(i) for i in node_ids]))

    def _rows(self, vectors: DataFrame, dim: int, order: str | None) -> tuple[str, DataFrame]:
        """(id, vector), checked, the last of each id by order (the order of files and their rows, if not given), stored."""
        seq = F.col(order) if order else F.monotonically_increasing_id()
        named = vectors.select(F.col(self.id_col).alias("i"), F.col(self.vec_col).alias("v"), seq.alias("seq"))
        rows = checked(named, dim, "i", "v", "seq")
        return self.store.scratch(last_writes(rows).select("id", "vector"))

    def _first_ids(self, dealt: DataFrame, first: int) -> tuple[dict[int, int], int]:
        """The first node id of each shard's new rows, and the next one after all; there are few shards beside the rows."""
        out = {}
        for r in sorted(dealt.groupBy("shard").count().collect()):
            out[r.shard], first = first, first + r["count"]
        return out, first

    @staticmethod
    def _per_cell(rows: DataFrame, cells: int) -> list[int]:
        """How many rows (cell) each cell has."""
        found = dict(map(tuple, rows.groupBy("cell").count().collect()))
        return [found.get(c, 0) for c in range(cells)]

    def build(self, vectors: DataFrame, order: str | None = None) -> None:
        """order: the column that tells which of several rows of one id came last."""
        first = vectors.select(F.size(self.vec_col)).first()
        if first is None:
            raise ValueError("no vectors")
        before = self.store.newest()[1]
        name, rows = self._rows(vectors, first[0], order)
        n, total = _sums(rows, first[0])
        center = (total / n).astype(np.float32)
        centres = fit_centres(rows, self.cfg.cells, self.cfg.seed) if self.cfg.cells > 1 else None
        one = Layout((1,) * (1 if centres is None else len(centres)), centres, self.cfg.boundary)
        each = one.assigned(rows)
        per_cell = [n] if centres is None else self._per_cell(each, one.cells)
        layout, _ = one.grown(per_cell, self.cfg.shard_rows)
        dealt = each.withColumn("shard", layout.shard(F.col("cell"), F.col("id")))
        ids, next_id = self._first_ids(dealt, 0)
        folder, _ = self.store.write(build_nodes(dealt.select("shard", "id", "vector", "copy"), center, ids, self.cfg))
        self.store.remove(name)
        kept = {} if centres is None else {"cells": centres.tolist(), "cell_rows": per_cell, "boundary": self.cfg.boundary}
        meta = Meta(first[0], self.cfg.max_degree, list(layout.subs), n, next_id, n, center.tolist(), total.tolist(), datetime.now(timezone.utc).isoformat(), folder, {folder: sorted(ids)}, **kept)
        for _ in range(TRIES):
            last, now = self.store.newest()
            try:
                self.store.commit(last + 1, replace(meta, batches=now.batches if now else {}))
                break
            except Conflict:
                continue
        else:
            raise RuntimeError("other writers were faster each time")
        if before and now and now.build == before.build and now.next_id > before.next_id:
            late = self.store.nodes(now).where(F.col("node_id") >= before.next_id).where(HOME)
            self.insert(late.select(F.col("id").alias(self.id_col), F.col("vector").alias(self.vec_col)))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, id, score: exact up to cfg.exact_up_to rows, by graph beyond (or always, if that is 0).

        Queries of more than BROADCAST bytes are joined (`search_join`); others are sent to all tasks.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        meta = self.meta()
        queries = checked(queries, meta.dim, self.id_col, self.vec_col).select(F.col("id").alias(self.id_col), F.col("vector").alias(self.vec_col))
        if 0 < meta.node_count <= self.cfg.exact_up_to:
            return knn_exact(self._scan(meta).where(HOME).select(F.col("id").alias(self.id_col), F.col("vector").alias(self.vec_col)), queries, k, id_col=self.id_col, vec_col=self.vec_col)
        if queries.count() * (8 * meta.dim + 16 * k) > BROADCAST:
            return self.search_join(queries, k)
        return graph_search(lambda shards: self._scan(meta, shards), queries, np.array(meta.centroid, np.float32), k, self.cfg, id_col=self.id_col, vec_col=self.vec_col, layout=Layout.of(meta))

    def search_join(self, queries: DataFrame, k: int) -> DataFrame:
        """search() for query sets as large as the index: both sides are shuffled, and no query passes the driver. Exact or by graph, as search() is."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        meta = self.meta()
        nodes = self._scan(meta)
        queries = checked(queries, meta.dim, self.id_col, self.vec_col)
        if 0 < meta.node_count <= self.cfg.exact_up_to:
            return knn_join(nodes.where(HOME).select("id", "vector"), queries, k, id_col="id", vec_col="vector")
        return graph_join(nodes, queries, np.array(meta.centroid, np.float32), k, self.cfg, Layout.of(meta), id_col="id", vec_col="vector")

    def search_with_rerank(self, queries: DataFrame, k: int, vectors: DataFrame | Callable[[DataFrame], DataFrame] | None, *, fallback: bool = False) -> DataFrame:
        """Candidates of search(), scored again with vectors kept elsewhere: a table, or what a function makes of the candidates' ids. None: as they are.

        If the function itself fails, so does the query, or, with fallback, candidates come as they are. What fails while its table is read always fails the query.
        """
        found = self.search(queries, self.cfg.beam(k)[0])
        try:
            table = vectors(found.select("id").distinct()) if callable(vectors) else vectors
        except Exception:
            if not fallback:
                raise
            table = None
        if table is None:
            return found.where(F.col("rank") <= k)
        return reranked(found, table, queries, k, self.id_col, self.vec_col)

    def insert(self, vectors: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """Only shards that get or lose rows, or that are split as the index grows, are read and written; where cells deal, also the ids of all nodes are read.

        batch: a stream and the number of its micro-batch, which is noted in the version; a number that isn't above the noted one inserts nothing.
        """
        if vectors.isEmpty():
            return
        name, rows = self._rows(vectors, self.meta().dim, order)
        try:
            for _ in range(TRIES):
                last, meta = self._newest()
                if batch and batch[1] <= meta.batches.get(batch[0], -1):
                    return
                now, folder = self._extended(meta, rows)
                try:
                    return self.store.commit(last + 1, replace(now, batches=meta.batches | dict([batch])) if batch else now)
                except Conflict:
                    self.store.remove(f"data/{folder}")
            raise RuntimeError("other writers were faster each time")
        finally:
            self.store.remove(name)

    def _extended(self, meta: Meta, rows: DataFrame) -> tuple[Meta, str]:
        was = Layout.of(meta)
        each, known = was.assigned(rows), None
        if was.centres is None:
            layout, split = was.grown([meta.node_count + rows.count()], self.cfg.shard_rows)
        else:  # a known id's nodes may be in other cells than its new vector
            known = self.store.nodes(meta).select("shard", "id").join(rows.select("id"), "id", "left_semi").withColumn("cell", F.col("shard") % was.cells)
            per_cell = [a - b + c for a, b, c in zip(meta.cell_rows, self._per_cell(known, was.cells), self._per_cell(each, was.cells), strict=True)]
            layout, split = was.grown(per_cell, self.cfg.shard_rows)
        dealt = each.withColumn("shard", layout.shard(F.col("cell"), F.col("id"))).select("shard", "id", "vector", "copy")
        ids, next_id = self._first_ids(dealt, meta.next_id)
        of = each.select(was.shard(F.col("cell"), F.col("id")).alias("shard"))
        touched = set(split) | {r.shard for r in (of if known is None else of.unionByName(known.select("shard"))).distinct().collect()}
        if known is not None:
            dealt = dealt.unionByName(known.select(layout.shard(F.col("cell"), F.col("id")).alias("shard"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(False).alias("copy")))
        old = self.store.nodes(meta, touched)
        rebuilt = set(split) | {s for children in split.values() for s in children}
        cfg = replace(self.cfg, max_degree=meta.max_degree)
        cell = F.col("shard") % was.cells
        new = insert_nodes(old.withColumn("shard", layout.shard(cell, F.col("id"))), dealt, np.array(meta.centroid, np.float32), ids, rebuilt, cfg)
        kept = {f: left for f, live in meta.folders.items() if (left := [s for s in live if s not in touched])}
        merged = self._to_merge(kept)
        moved = {s for f in merged for s in kept.pop(f)}
        folder, written = self.store.write(new.unionByName(self.store.nodes(meta, moved)) if moved else new)
        own = sorted(r.shard for r in written.select("shard").distinct().collect())
        n_was, sum_was = _sums(old.where(HOME), meta.dim)
        n_now, sum_now = _sums(written.where(~F.col("shard").isin(sorted(moved))).where(HOME), meta.dim)
        total = np.array(meta.total) + sum_now - sum_was
        return replace(
            meta, subs=list(layout.subs), node_count=meta.node_count + n_now - n_was, next_id=next_id, total=total.tolist(),
            folders=kept | {folder: own}, cell_rows=[] if known is None else per_cell,
        ), folder

    def set_neighbours(self, changes: DataFrame) -> None:
        """Nodes (node_id) get the neighbours that changes (node_id, neighbors array<long>) states; only their shards are written anew.

        Neighbours should be nodes of the same shard: searches pass over others. A node that isn't there is passed over, too; node ids of changes are distinct.
        """
        for _ in range(TRIES):
            last, meta = self._newest()
            touched = {r.shard for r in self.store.nodes(meta).select("shard", "node_id").join(changes.select("node_id"), "node_id", "left_semi").select("shard").distinct().collect()}
            if not touched:
                return
            folder, _ = self.store.write(with_neighbours(self.store.nodes(meta, touched), changes).repartition("shard").sortWithinPartitions("shard", "node_id"))
            kept = {f: left for f, live in meta.folders.items() if (left := [s for s in live if s not in touched])}
            try:
                return self.store.commit(last + 1, replace(meta, folders=kept | {folder: sorted(touched)}))
            except Conflict:
                self.store.remove(f"data/{folder}")
        raise RuntimeError("other writers were faster each time")

    def _to_merge(self, folders: dict[str, list[int]]) -> list[str]:
        """Data folders whose shards the next one takes over: none while there are few, else the smaller half, so that a shard is copied a logarithmic number of times."""
        if len(folders) < self.cfg.max_folders:
            return []
        return sorted(folders, key=lambda f: (len(folders[f]), f))[: -(-len(folders) // 2)]

    def tracker(self) -> Tracker:
        meta = self.meta()
        return Tracker(np.array(meta.centroid, np.float32).astype(float), np.array(meta.total), meta.node_count, meta.vectors_at_build)

    def drift(self) -> DataFrame:
        """One row: drift of the mean, inserts per vector at build, and whether either calls for a rebuild."""
        t = self.tracker()
        return self.spark.createDataFrame([(t.drift, t.inserts_since / t.build_count if t.build_count else 0.0, t.needs_rebuild(self.cfg))], "drift double, insert_ratio double, needs_rebuild boolean")

    def needs_rebuild(self) -> bool:
        return self.store.newest()[1] is not None and self.tracker().needs_rebuild(self.cfg)

    def rebuild_async(self, vectors: DataFrame) -> Rebuild:
        """build() in the background; searches go on with the version before until it is committed. result() carries any error."""
        return Rebuild(self, vectors)

    def warm(self, shards: int | None = None) -> int:
        """Keeps the nodes of so many shards (of all, if not given) in memory until close(), for searches of this object; how many nodes these are.

        A shard that an insert or a build writes anew is read from its file again, until the next warm().
        """
        self.close()
        meta = self.meta()
        live = {s: f for f, own in meta.folders.items() for s in own}
        chosen = set(sorted(live)[:shards])
        held = self.store.nodes(meta, chosen).persist(StorageLevel.MEMORY_AND_DISK)
        self._warm = {s: live[s] for s in chosen}, held
        return held.count()

    def close(self) -> None:
        if self._warm is not None:
            self._warm[1].unpersist()
            self._warm = None

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.store.vacuum(keep)
