"""The proximity graph: one per shard of bounded size, built, extended and searched in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annora.config import IndexConfig
from annora.functions import kernels
from annora.operators.knn import TASKS, Best, l2_near, matrix_of, query_blocks
from annora.operators.routing import Layout, split_shards  # noqa: F401
from annora.session import shared_dir
from annora.sources.store import NODES


def checked(vectors: DataFrame, dim: int, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """(id, vector, keep) with an error where a vector is null, of another length or holds null or non-finite elements."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).otherwise(F.raise_error(F.concat(F.lit("bad vector for id "), F.col(id_col).cast("string")))).cast("array<float>").alias("vector"), *keep)


def last_writes(vectors: DataFrame, order: str = "seq") -> DataFrame:
    """Of rows (id, vector, order) with one id, the last."""
    w = Window.partitionBy("id").orderBy(F.col(order).desc())
    return vectors.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def build_nodes(vectors: DataFrame, center: np.ndarray, first_ids: dict[int, int], cfg: IndexConfig) -> DataFrame:
    """Nodes (see NODES) of vectors (shard, id, vector, copy). Node ids are counted from a shard's own first one, in order of id."""
    centroid = np.array(center, np.float32)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        shard = int(pdf["shard"].iloc[0])
        v = np.stack(pdf.vector.to_numpy()).astype(np.float32)
        return _frame(shard, first_ids[shard] + np.arange(len(pdf)), pdf.id.to_numpy(), v, *_built(v, shard, cfg), centroid, pdf["copy"].to_numpy())

    return spread(vectors, 1 + max(first_ids, default=0)).groupBy("shard").applyInPandas(run, NODES)


def spread(rows: DataFrame, shards: int) -> DataFrame:
    """rows, each shard (numbered below shards) in a partition of its own, or so evenly, beyond TASKS: a shard is minutes of work but few bytes, of which Spark would put many into one task."""
    return rows.repartitionById(max(1, min(shards, TASKS)), "shard")


def _built(v: np.ndarray, shard: int, cfg: IndexConfig) -> tuple[list[list[int]], int]:
    return kernels.build_graph(v, degree=cfg.max_degree, search_list=cfg.search_list, passes=cfg.build_passes, alpha=cfg.alpha, seed=cfg.seed + shard)


def _frame(shard: int, node_ids: np.ndarray, ids: np.ndarray, v: np.ndarray, graph: list[list[int]], start: int, centroid: np.ndarray, copy: np.ndarray) -> pd.DataFrame:
    codes, sq, l1 = kernels.encode(v, centroid)
    near = [node_ids[np.array(g, np.int64)].astype(np.int64) for g in graph]
    frame = pd.DataFrame({"shard": np.int32(shard), "node_id": node_ids.astype(np.int64), "id": ids, "vector": list(v), "code": [c.tobytes() for c in codes], "sq_norm": sq, "l1_norm": l1, "neighbors": near, "entry": np.arange(len(ids)) == start, "copy": copy.astype(bool)})
    return frame.sort_values("node_id")


class Shard:
    """A shard's nodes as arrays; neighbours are places in them."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows["node_id"]))
        self.node_ids, self.ids = rows["node_id"].to_numpy(), rows["id"].to_numpy()
        flat, size = self._lists(rows["neighbors"])
        place = np.minimum(np.searchsorted(self.node_ids, flat), max(0, len(self.node_ids) - 1))
        known = self.node_ids[place] == flat if len(flat) else np.empty(0, bool)
        cuts = np.cumsum(size)[:-1]
        self.graph = [p[k] for p, k in zip(np.split(place, cuts), np.split(known, cuts), strict=True)]
        self.near = kernels.Adjacency(self.graph, max(1, *map(len, self.graph))).near
        entry = np.flatnonzero(rows["entry"].to_numpy(zero_copy_only=False))
        if len(entry) != 1:
            raise RuntimeError("a shard's file is incomplete or was split")
        self.start, self.rows = int(entry[0]), rows

    @staticmethod
    def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)

    def vectors(self) -> np.ndarray:
        return self._lists(self.rows["vector"])[0].reshape(len(self.ids), -1)

    def signs(self, dim: int) -> np.ndarray:
        codes = np.frombuffer(b"".join(self.rows["code"].to_pylist()), np.uint8)
        return kernels.signs(codes.reshape(len(self.ids), -1), dim)


def by_shard(nodes: DataFrame, work: Callable[[int, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work on each shard of nodes, whose first column is shard. Nothing is shuffled: a shard's rows are neighbours in one task, as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and of[a] != shard:
                    yield work(int(shard), pa.Table.from_batches(held))
                    held = []
                shard = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield work(int(shard), pa.Table.from_batches(held))

    return nodes.mapInArrow(run, schema)


#: Queries that a task searches side by side.
TOGETHER = 64
#: Bytes of queries and of what is kept of them that a task of a join searches for, and nodes of small shards that it looks into, about.
BLOCK, BUNDLE = 8 << 20, 16_384


def graph_search(nodes: DataFrame | Callable[[set[int]], DataFrame], queries: DataFrame, center: np.ndarray, k: int, cfg: IndexConfig, *, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = 32 << 20, layout: Layout | None = None) -> DataFrame:
    """The k nearest by best-first search over codes in shards and exact re-ranking: query_id, rank, id, score.

    Queries go out in blocks; nodes aren't shuffled. Every shard is searched for every query, or, with a layout that has centres, those
    of the cfg.probes cells nearest to the query: nodes then gives those of some shards, and only what a query of the block needs is read.
    """
    centroid = np.array(center, np.float32)
    sc, found = queries.sparkSession.sparkContext, None
    schema = "query_id long, id long, score double"
    cells = layout.cells if layout else 1

    answer = _searcher(centroid, k, cfg)

    def searcher(shared):
        def work(number: int, rows: pa.Table) -> pa.RecordBatch:
            ids, asked, probed = shared.value
            own = np.ones(len(ids), bool) if probed is None else (probed == number % cells).any(1)
            return answer(rows, ids[own], asked[own])

        return work

    for ids, rows in query_blocks(queries.select(F.col(id_col).cast("long"), vec_col), block_bytes, len(centroid)):
        if rows.shape[1] != len(centroid):
            raise ValueError(f"queries have {rows.shape[1]} elements, the index {len(centroid)}")
        probed = layout.probed(rows, cfg.probes) if layout else None
        scan = nodes if isinstance(nodes, DataFrame) else nodes(layout.shards(set(range(cells) if probed is None else np.unique(probed).tolist())))
        part = by_shard(scan, searcher(sc.broadcast((ids, rows, probed))), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    return _ranked(found, k, layout is not None and layout.centres is not None)


def _searcher(centroid: np.ndarray, k: int, cfg: IndexConfig, beams: bool = True) -> Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]:
    """(nodes of one or several shards, query ids, query vectors) -> (query_id, id, score): the k nearest of what the search over codes finds in each.

    With cfg.verify, all of a shard's vectors within the distance of the last that the search found (any, without beams) are looked at, too: then these are its k nearest.
    """
    rerank, width = cfg.beam(k)

    def answer(rows: pa.Table, ids: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        out, met_ids, met_rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], [], []
        for part in _parts(rows) if len(ids) else ():
            shard = Shard(part)
            v = shard.vectors()
            if rerank >= len(v) or (cfg.verify and not beams):
                # A beam as wide as the shard ends up with all that the entry reaches, whatever the query, and all of it is re-ranked.
                met = np.arange(len(v)) if cfg.verify else np.flatnonzero(kernels.reached_by(shard.near, shard.start))
                met_ids.append(shard.ids[met])
                met_rows.append(v[met])
                continue
            sq, l1, sign = rows_of(shard, "sq_norm"), rows_of(shard, "l1_norm"), shard.signs(v.shape[1])
            far = np.full(len(ids), np.inf)
            for at in range(0, len(ids), TOGETHER):
                q = asked[at : at + TOGETHER]
                best, _ = kernels.search_many(kernels.code_table(q, centroid, sign, sq, l1), len(q), shard.near, shard.start, width)
                for which, (qid, one, met) in enumerate(zip(ids[at : at + TOGETHER], q, best[:, :rerank], strict=True), at):
                    met = met[met >= 0]
                    d = kernels.l2_to(one, v[met])
                    first = np.lexsort((shard.ids[met], d))[:k]
                    if not cfg.verify:
                        out.append((np.full(len(first), qid), shard.ids[met[first]], d[first]))
                    elif len(first) == k:
                        far[which] = d[first[-1]] * (1 + 1e-9)  # these sums may differ from the check's in their last digits
            if cfg.verify:
                own = Best(ids, asked.astype(np.float64), k, far)
                own.meet(shard.ids, (v.astype(np.float64),), l2_near)
                out.extend(tuple(c.to_numpy() for c in batch.columns) for batch in own.batches())
        if met_ids:
            own = Best(ids, asked.astype(np.float64), k)
            own.meet(np.concatenate(met_ids), (np.concatenate(met_rows).astype(np.float64),), l2_near)
            out.extend(tuple(c.to_numpy() for c in batch.columns) for batch in own.batches())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

    return answer


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    """The rows of each shard, where rows has a column shard and may hold several."""
    if not len(rows) or "shard" not in rows.column_names:
        return iter([rows] if len(rows) else [])
    rows = rows.take(pc.sort_indices(rows["shard"]))
    cuts = np.flatnonzero(np.diff(rows["shard"].to_numpy())) + 1
    return (rows.slice(a, b - a) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True))


def _ranked(found: DataFrame, k: int, twice: bool) -> DataFrame:
    """The k best rows of each query; twice: a vector near a boundary may be found in two cells."""
    if twice:
        found = found.repartition("query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def graph_join(nodes: DataFrame, queries: DataFrame, center: np.ndarray, k: int, cfg: IndexConfig, layout: Layout, *, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """What graph_search() returns, for query sets of any size: no query passes the driver.

    Queries are sent to the shards that they look into, in blocks of about block_rows (BLOCK bytes, if not given), so that a cell that very many of them look
    into is searched by several tasks; nodes are shuffled, as many times as their cell has blocks. Small shards of a cell are put together to bundles of BUNDLE
    nodes at most, so that a query is sent to each bundle, not to each shard. The driver counts queries per cell. With cfg.verify the vectors of the cells looked
    into are compared without a search by the graph before, which only pays for few queries: the rows are the same.
    """
    block_rows = block_rows or max(1, BLOCK // (8 * len(center) + 16 * k))
    centroid, cells, probes = np.array(center, np.float32), layout.cells, cfg.probes
    answer = _searcher(centroid, k, cfg, beams=False)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                probed = layout.probed(matrix_of(batch.column(1)), probes)
                probed = np.zeros((len(batch), 1), np.int64) if probed is None else probed
                own = batch.take(pa.array(np.repeat(np.arange(len(batch)), probed.shape[1])))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(probed.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("q")).mapInArrow(routed, "query_id long, q array<float>, cell int")
    count = dict(map(tuple, asked.groupBy("cell").count().collect()))
    blocks = F.array(*(F.lit(max(1, -(-count.get(c, 0) // block_rows))) for c in range(cells)))
    per = max(1, BUNDLE // cfg.shard_rows)
    bundles = F.array(*(F.lit(-(-sub // per)) for sub in layout.subs))
    asked = asked.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.get(bundles, F.col("cell")) - 1)))
    asked = asked.select("query_id", "q", "cell", "bundle", F.pmod(F.xxhash64("query_id"), F.get(blocks, F.col("cell"))).cast("int").alias("block"))
    cell = F.col("shard") % cells
    wanted = nodes.where(cell.isin(sorted(count))) if len(count) < cells else nodes
    needed = wanted.select("shard", "node_id", "id", "vector", "code", "sq_norm", "l1_norm", "neighbors", "entry", cell.alias("cell"), F.floor(F.col("shard") / cells / per).cast("int").alias("bundle"))
    dealt = needed.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)))
    groups = sum(-(-sub // per) * max(1, -(-count.get(c, 0) // block_rows)) for c, sub in enumerate(layout.subs))
    tasks = max(1, min(2 * groups, TASKS))

    def work(own: pa.Table, some: pa.Table) -> pa.Table:
        ids = some["query_id"].to_numpy() if len(own) else np.empty(0, np.int64)
        rows = matrix_of(some["q"].combine_chunks()).astype(np.float32) if len(ids) else np.empty((0, len(centroid)))
        if len(ids) and rows.shape[1] != len(centroid):
            raise ValueError(f"queries have {rows.shape[1]} elements, the index {len(centroid)}")
        return pa.Table.from_batches([answer(own, ids, rows)])

    sides = (df.repartition(tasks, "cell", "bundle", "block").groupBy("cell", "bundle", "block") for df in (dealt, asked))
    found = next(sides).cogroup(next(sides)).applyInArrow(work, "query_id long, id long, score double")
    return _ranked(found, k, layout.centres is not None)


def rows_of(shard: Shard, column: str) -> np.ndarray:
    return shard.rows[column].to_numpy()


def insert_nodes(nodes: DataFrame, new: DataFrame, center: np.ndarray, first_ids: dict[int, int], rebuilt: set[int], cfg: IndexConfig) -> DataFrame:
    """nodes, dealt by shard, with the vectors new (shard, id, vector, copy): searched for and linked as in a build.

    A known id replaces its row: the old node goes, with the edges to it; a null vector only does that. Shards in rebuilt are built anew from all they hold.
    """
    centroid = np.array(center, np.float32)

    def run(key: tuple, old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        gone = old.id.isin(fresh.id).to_numpy()
        kept, fresh = old[~gone].sort_values("node_id"), fresh[fresh.vector.notna()].sort_values("id")
        if not len(kept) + len(fresh):
            return pd.DataFrame(columns=NODES.replace(",", "").split()[::2])
        ids, copy = (np.concatenate([kept[c].to_numpy(), fresh[c].to_numpy()]) for c in ("id", "copy"))
        node_ids = np.concatenate([kept.node_id.to_numpy(np.int64), first_ids.get(shard, 0) + np.arange(len(fresh))])
        v = np.stack([*kept.vector, *fresh.vector]).astype(np.float32)
        if shard in rebuilt or not len(kept) or not kept.entry.any():
            return _frame(shard, node_ids, ids.astype(np.int64), v, *_built(v, shard, cfg), centroid, copy)
        place = {int(x): i for i, x in enumerate(kept.node_id)}
        graph = [[place[j] for j in map(int, near) if j in place] for near in kept.neighbors]
        start = int(np.flatnonzero(kept.entry)[0])
        graph = kernels.extend_graph(graph, v, start, degree=cfg.max_degree, search_list=cfg.search_list, alpha=cfg.alpha)
        return _frame(shard, node_ids, ids.astype(np.int64), v, graph, start, centroid, copy)

    shards = 1 + max({*first_ids, *rebuilt}, default=0)
    return spread(nodes, shards).groupBy("shard").cogroup(spread(new, shards).groupBy("shard")).applyInPandas(run, NODES)


def reachable(nodes: DataFrame) -> DataFrame:
    """(nodes, reached): how many nodes there are, and how many the entries reach."""

    def count(_: int, rows: pa.Table) -> pa.RecordBatch:
        shard = Shard(rows)
        return pa.RecordBatch.from_arrays([pa.array([len(shard.ids)]), pa.array([int(kernels.reached(shard.graph, shard.start).sum())])], names=["nodes", "reached"])

    per = by_shard(nodes.select("shard", "node_id", "id", "neighbors", "entry"), count, "nodes long, reached long")
    return per.agg(F.sum("nodes").alias("nodes"), F.sum("reached").alias("reached"))


def within_hops(nodes: DataFrame, depth: int) -> DataFrame:
    """(shard, node_id, hop) of the nodes that are depth edges at most from their shard's entry."""

    def near(number: int, rows: pa.Table) -> pa.RecordBatch:
        shard = Shard(rows)
        hop = kernels.hops(shard.graph, shard.start, depth)
        at = np.flatnonzero(hop >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(shard.node_ids[at]), pa.array(hop[at].astype(np.int32))], names=["shard", "node_id", "hop"])

    return by_shard(nodes.select("shard", "node_id", "id", "neighbors", "entry"), near, "shard int, node_id long, hop int")


def hops_across(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(node_id, hop) of the nodes that are depth edges at most (any number, if not given) from an entry, over edges that may lead to other shards.

    A step joins the nodes that the one before found with all edges and leaves out what is known, and is checkpointed; the driver learns whether it found any.
    Edges to nodes that aren't there lead nowhere.
    """
    shared_dir(nodes.sparkSession)
    there = nodes.select(F.col("node_id").alias("dst"))
    links = nodes.select(F.col("node_id").alias("src"), F.explode("neighbors").alias("dst")).join(there, "dst", "left_semi").checkpoint()
    found = latest = nodes.where("entry").select("node_id", F.lit(0).alias("hop")).checkpoint()
    step = 0
    while step != depth and not latest.isEmpty():
        step += 1
        met = links.join(latest.select(F.col("node_id").alias("src")), "src").select(F.col("dst").alias("node_id")).distinct()
        latest = met.join(found, "node_id", "left_anti").withColumn("hop", F.lit(step)).checkpoint()
        found = found.unionByName(latest)
    return found


#: Jumps that are doubled at most, per edge between components; beyond, steps go by shorter ones.
JUMPS = 4


def reached_across(nodes: DataFrame) -> DataFrame:
    """(node_id) of the nodes that an entry reaches, over edges that may lead to other shards: hops_across() without the hops, in a logarithmic number of rounds.

    Each shard's nodes are put together to groups that reach each other (strong components), one task a shard. Over the edges between groups, jumps of 1, 2, 4 and so on edges are
    joined, each from the one before, and taken from the longest to the shortest: that reaches any number of edges below twice the longest. Where jumps branch so
    much that they are more than JUMPS times the edges, doubling stops, and rounds are repeated until nothing is new.
    """
    shared_dir(nodes.sparkSession)

    def group(rows: pa.Table) -> pa.Table:
        ids = rows["node_id"].to_numpy()
        flat, size = Shard._lists(rows["neighbors"])
        order = np.argsort(ids)
        place = order[np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)] if len(flat) else np.empty(0, np.int64)
        return pa.table({"node_id": ids, "root": ids[kernels.strong_components(len(ids), np.repeat(np.arange(len(ids)), size)[ids[place] == flat], place[ids[place] == flat])]})

    groups = spread(nodes.select("shard", "node_id", "neighbors"), 100).groupBy("shard").applyInArrow(group, "node_id long, root long").checkpoint()
    links = nodes.select("node_id", F.explode("neighbors").alias("dst")).join(groups.withColumnRenamed("root", "a"), "node_id")
    links = links.join(groups.select(F.col("node_id").alias("dst"), F.col("root").alias("b")), "dst").where("a <> b").select("a", "b").distinct().checkpoint()
    count, far, jumps = links.count(), 1, [links]
    while far < count:
        twice = jumps[-1].join(jumps[-1].select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct().limit(JUMPS * count + 1).checkpoint()
        n, far = twice.count(), 2 * far
        if not 0 < n <= JUMPS * count:
            break
        jumps.append(twice)
    met = groups.join(nodes.where("entry").select("node_id"), "node_id").select(F.col("root").alias("a")).distinct().checkpoint()
    known = -1
    while known != (known := met.count()):
        for jump in reversed(jumps):
            met = met.unionByName(jump.join(met, "a", "left_semi").select(F.col("b").alias("a"))).distinct().checkpoint()
    return groups.join(met.withColumnRenamed("a", "root"), "root", "left_semi").select("node_id")


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select("shard", F.col("node_id").alias("src"), F.posexplode("neighbors").alias("pos", "dst"))


def with_neighbours(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes whose neighbours are those that changes (node_id, neighbors) states, where it does."""
    new = changes.select("node_id", F.col("neighbors").alias("_new"))
    return nodes.join(new, "node_id", "left").withColumn("neighbors", F.coalesce("_new", "neighbors")).select(*nodes.columns)


def degree_stats(nodes: DataFrame, most: int) -> DataFrame:
    d = F.size("neighbors")
    return nodes.agg(F.min(d).alias("min_degree"), F.max(d).alias("max_degree"), F.avg(d).alias("avg_degree"), F.count_if(d > most).alias("over"), F.count_if(d == 0).alias("alone"))
