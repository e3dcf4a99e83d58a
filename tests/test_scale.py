"""What made queries slow, large or inexact on larger tables."""

import os

import numpy as np
from pyspark.sql import functions as F

from annora.config import IndexConfig
from annora.functions import kernels
from annora.index import VectorIndex
from annora.operators import knn
from annora.operators.graph import spread


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")


def normal(n, dim, seed=42):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


def test_few_pairs_are_summed_and_none_is_lost(monkeypatch):
    """Before, each pair's differences were summed. Scores are the sums from first to last, bit for bit; copies, huge and undefined values included."""
    v = normal(3000, 16).astype(float) + 100
    v[40:80], v[5], v[6, 3] = v[:40], 1e200, np.nan
    summed, real = [], knn.l2_of
    monkeypatch.setattr(knn, "l2_of", lambda a, b: summed.append(len(a)) or real(a, b))
    best = knn.Best(np.arange(500), v[:500], 4)
    for at in range(0, 3000, 700):
        best.meet(np.arange(at, min(at + 700, 3000)), (v[at : at + 700],), knn.l2_near)
    for q in (0, 41, 77, 499):
        d = np.zeros(3000)
        for i in range(16):
            d += (v[q, i] - v[:, i]) ** 2
        first = np.lexsort((np.arange(3000), d))[:4]
        assert best.rows[q].tolist() == first.tolist() and best.scores[q].tobytes() == d[first].tobytes()
    fine, summed[:] = np.delete(v, [5, 6], 0), []
    knn.Best(np.arange(500), fine[:500], 4).meet(np.arange(len(fine)), (fine,), knn.l2_near)
    assert sum(summed) < 500 * len(fine) / 20


def test_a_join_of_few_bytes_is_shared_by_tasks(spark, monkeypatch):
    """Before, the pairs of 8 MB of vectors were one task's work, however many there were."""
    monkeypatch.setattr(knn, "PAIRS", 10_000, raising=False)
    rows = frame(spark, normal(400, 4))
    found = knn.knn_join(rows, rows, 3)
    assert knn.nearest_in_blocks(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3, knn._vectors, knn.l2_near, 8 << 20).rdd.getNumPartitions() >= 16
    assert found.exceptAll(knn.knn_exact(rows, rows, 3)).count() == 0 and found.count() == 1200


def test_a_larger_join_has_larger_blocks(spark, monkeypatch):
    """Before, blocks had a stated number of rows, so that each row was shuffled as many times as there were blocks: disk grew with the square of the rows."""
    monkeypatch.setattr(knn, "PAIRS", 100)
    monkeypatch.setattr(knn, "SPLIT", 9, raising=False)
    rows = frame(spark, np.concatenate([normal(300, 4), normal(20, 4)]))
    found = knn.knn_join(rows, rows, 3)
    named = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert knn.nearest_in_blocks(named, named, 3, knn._vectors, knn.l2_near, 8 << 20).rdd.getNumPartitions() == 9
    assert found.exceptAll(knn.knn_exact(rows, rows, 3)).count() == 0 and found.count() == 960
    monkeypatch.undo()
    for n in (10**5, 10**6):
        a, b = knn._blocks(n, n, 512, 560, 32 << 20)
        assert a + b < 40 and a * b >= 140
        assert sum(knn._blocks(n, n // 50, 512, 560, 32 << 20)) < 150
    assert max(knn._blocks(10**8, 10**8, 512, 560, 32 << 20)) > 10**8 * 512 / (33 << 20)
    assert knn._blocks(1, 1, 8, 8, 1) == (8, 8) and knn._blocks(5, 0, 8, 8, 100) == (1, 1)


def exact(v, q, k):
    return np.lexsort((np.arange(len(v)), knn.l2_of(v.astype(float), v[q : q + 1].astype(float))))[:k].tolist()


def test_a_verified_search_misses_nothing(spark, tmp_path):
    """A graph of few links and a narrow beam miss neighbours in shards larger than the beam; the check adds them, to searches, joins and re-ranking."""
    from dataclasses import replace

    v, cfg = normal(900, 8), IndexConfig(exact_up_to=0, max_degree=4, search_list=4, build_passes=0, rerank_top_n=6, ef_search=6, verify=True)
    v[100:104] = v[:4]
    for n, cells in enumerate((0, 5)):
        index = VectorIndex(spark, str(tmp_path / f"i{n}"), replace(cfg, cells=cells, probes=5))
        index.build(frame(spark, v))
        loose = VectorIndex(spark, str(tmp_path / f"i{n}"), replace(index.cfg, verify=False))
        asked = frame(spark, v[:40])
        results = [{q: [r.id for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in _grouped(df).items()} for df in (index.search(asked, 2), index.search_join(asked, 2), index.search_with_rerank(asked, 2, frame(spark, v)), loose.search(asked, 2))]
        want = {q: exact(v, q, 2) for q in range(40)}
        assert results[0] == results[1] == results[2] == want and results[3] != want


def _grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_small_shards_are_searched_together(spark, tmp_path):
    """Before, each query was sent to each shard and searched there by a beam of its own; now once to all of a cell's, where their nodes are scored at once."""
    v = normal(400, 8)
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(exact_up_to=0, max_degree=8, search_list=16, build_passes=1, shard_rows=40))
    index.build(frame(spark, v))
    assert index.meta().shards == 20
    found = index.search_join(frame(spark, v), 3)
    assert "bundle" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {q: [r.id for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in _grouped(found).items()} == {q: exact(v, q, 3) for q in range(400)}


def test_pairs_are_streamed(spark, monkeypatch):
    """Before, Spark's own cross join evaluated lists of 64 expressions a pair, in as many tasks as the table had files; scores are the same bit for bit."""
    from annora.functions import columns as V
    from annora.operators.quantize import encoded, pairs

    monkeypatch.setattr(knn, "MADE", 500)
    v = normal(200, 9)
    v[3] = v[4]
    enc = encoded(frame(spark, v).coalesce(1))
    made = pairs(enc, enc.where("id % 20 = 0"), "dot differ d")
    assert made.rdd.getNumPartitions() == 4 and "Join" not in made.select("id")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    c = {r.id: r for r in enc.collect()}
    rows = made.collect()
    assert len({(r.query_id, r.id) for r in rows}) == len(rows) == 2000
    for r in rows:
        q, o, dot, d = c[r.query_id], c[r.id], 0.0, 0.0
        for x, y in zip(q.v, o.v, strict=True):
            dot += x if y >= 0 else -x
            d += (x - y) * (x - y)
        assert (r.qsq, r.sq_norm, r.l1_norm, r.dim, r.dot, r.d) == (q.sq_norm, o.sq_norm, o.l1_norm, 9, dot, d)
        assert r.differ == sum((x >= 0) != (y >= 0) for x, y in zip(q.v, o.v, strict=True))
    est = made.select(V.sym_of(F.lit(1.0), F.lit(2.0), F.col("differ"), F.col("dim")).alias("x"))
    assert est.count() == 2000 and pairs(enc, enc.limit(0)).count() == 0


def test_ranks_without_a_checkpoint(spark, tmp_path):
    """Before, all pairs were checkpointed and shuffled twice for each of the two ranks."""
    from annora.operators.evaluate import spearman

    rows = spark.range(400).select((F.col("id") % 2).alias("query_id"), "id", F.floor(F.col("id") / 7).alias("a"), F.pmod(F.col("id") * 37, F.lit(91)).alias("b"))
    plan = (got := spearman(rows, "a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "ExistingRDD" not in plan
    want = {}
    for q in (0, 1):
        at = np.arange(q, 400, 2)
        ra, rb = (np.argsort(np.lexsort((at, x))) for x in (at // 7, at * 37 % 91))
        want[q] = 1 - 6 * ((ra - rb).astype(float) ** 2).sum() / (200 * (200 * 200 - 1))
    assert {r.query_id: round(r.rho, 12) for r in got.collect()} == {q: round(x, 12) for q, x in want.items()}


def test_no_pair_is_shuffled_to_be_ranked(spark, tmp_path, monkeypatch):
    """Before, each query's pairs were shuffled, 24 bytes each, so that disk grew with the square of the rows. Copies, and pairs beyond what a task holds, included."""
    from annora.operators import evaluate
    from annora.plans.catalogue import spearman_rho

    v = np.round(normal(300, 6), 1)
    v[60:110], v[7] = v[50], v[50]
    frame(spark, v).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = spearman_rho(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Groups" not in plan
    c = v.astype(float) - v.astype(float).mean(0).astype(np.float32).astype(float)
    sq, l1, want = (c * c).cumsum(1)[:, -1], np.abs(c).cumsum(1)[:, -1], {}
    for q in range(0, 300, 50):
        dot = np.where(c >= 0, c[q], -c[q]).cumsum(1)[:, -1]
        ra, rb = (np.argsort(np.lexsort((np.arange(300), x))) for x in (sq[q] + sq - 2 * sq * dot / l1, knn.l2_of(c, c[q : q + 1])))
        want[q] = round(1 - 6 * ((ra - rb).astype(float) ** 2).sum() / (300 * (300 * 300 - 1)), 6)
    for held in (evaluate.HELD, 1300, 299):
        monkeypatch.setattr(evaluate, "HELD", held)
        monkeypatch.setattr(evaluate, "SENT", 41)
        assert {r.query_id: r.rho for r in spearman_rho(spark, str(tmp_path)).collect()} == want


def test_a_long_chain_of_shards_is_reached_in_few_rounds(spark, monkeypatch):
    """Before, each edge of the longest path was a join and a checkpoint of its own. With branching and cycles, edges that lead nowhere, and where doubling stops."""
    from annora.operators import graph as G

    rows = [(i // 2, i, [i + 1, 9999] if i % 7 else [i + 1, i - 2], i == 0) for i in range(60)] + [(30 + i, 100 + i, [5], False) for i in range(3)]
    nodes = spark.createDataFrame([(s, n, [x for x in near if x != 41], e) for s, n, near, e in rows], "shard int, node_id long, neighbors array<long>, entry boolean")
    want = {r.node_id for r in G.hops_across(nodes).collect()}
    assert len(want) == 41
    for most in (4, 0):
        monkeypatch.setattr(G, "JUMPS", most)
        assert {r.node_id for r in G.reached_across(nodes).collect()} == want


def test_strong_components():
    rng = np.random.default_rng(1)
    for n in (1, 5, 12):
        a = rng.random((n, n)) < 1.4 / n
        far = np.eye(n, dtype=bool) | a
        for _ in range(n):
            far = far | (far.astype(int) @ far.astype(int) > 0)
        root = kernels.strong_components(n, *np.nonzero(a))
        assert ((root[:, None] == root) == (far & far.T)).all()


def test_op4_leaves_two_scratch_tables(spark):
    """Before, all fifteen stayed until drop_scratch()."""
    from annora.llm import common
    from annora.llm.op4_lines import line_classes

    before = set(common._scratch)
    docs = spark.createDataFrame([(i, f"one line of some words {i % 3}\nand another one that is longer {i}") for i in range(8)], "doc_id long, text string")
    assert line_classes(docs).count() == 16
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(common._scratch) - before) == ["lines-known", "lines-scan"]


def test_each_shard_is_a_task_of_its_own(spark):
    """A hash of the shard's number put several of twenty shards into one partition, one after the other, and left others empty."""
    rows = spread(spark.range(400).select((F.col("id") % 20).cast("int").alias("shard"), "id"), 20)
    per = rows.select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert [r["count"] for r in per] == [1] * 20


def test_tables_of_distances_are_what_measures_tell():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[:40] = v[40]
    graph, start = kernels.build_graph(v, degree=12, search_list=24, passes=1, alpha=1.2, seed=3)
    near, c = kernels.Adjacency(graph, 12).near, v[40]
    codes, sq, l1 = kernels.encode(v, c)
    sign, every, q = kernels.signs(codes, 16), np.arange(700), v[::70]
    rows, nodes = np.repeat(np.arange(10), 700), np.tile(every, 10)
    tables = kernels.exact_table(q, v, np.einsum("ij,ij->i", v, v)), kernels.code_table(q, c, sign, sq, l1)
    measures = kernels.exactly(q, v), kernels.by_codes(q, c, sign, sq, l1)
    for table, measure in zip(tables, measures, strict=True):
        assert np.allclose(table, measure(rows, nodes).reshape(10, -1), atol=1e-4)
        for width in (50, 800):  # also wider than the graph
            found, known = (kernels.search_many(m, 10, near, start, width)[0] for m in (measure, table))
            # Ties aside, the same nodes: those of the same distances.
            far = [np.sort(np.take_along_axis(table, np.maximum(x, 0), 1), 1) for x in (found, known)]
            assert ((found >= 0) == (known >= 0)).all() and np.allclose(*far, atol=1e-4)


def test_pruning_stops_once_all_have_their_degree(monkeypatch):
    """Of far apart candidates the nearest ones fill a node up; distances between the others used to be taken all the same."""
    v, taken = np.eye(300, dtype=np.float32), []
    monkeypatch.setattr(kernels, "_bits", lambda flags, real=kernels._bits: taken.append(flags.shape) or real(flags))
    pools = [np.arange(300)] * 4
    found = kernels.prune_many(np.arange(4), pools, v, 1.2, 40)
    assert found == [kernels.robust_prune(i, p, v, 1.2, 40) for i, p in enumerate(pools)]
    assert len(taken) == 2  # one tier of 64: what it rules out, and what it has


def test_op4_keeps_no_broadcast(spark, monkeypatch):
    """The sieves, 64 MB for the driver and each executor, used to stay on disk until the driver's memory was collected."""
    from pyspark import SparkContext

    from annora.llm.common import drop_scratch
    from annora.llm.op4_lines import line_classes

    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(real(self, value)) or sent[-1])
    docs = spark.createDataFrame([(1, "a line of some words, no. 1"), (2, "a line of some words, no. 2")], "doc_id long, text string")
    assert {r.class_id for r in line_classes(docs).collect()} and len(sent) == 2
    assert not any(os.path.exists(b._path) for b in sent)
    drop_scratch(spark)
