import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from annora.config import IndexConfig
from annora.functions import kernels
from annora.functions.codec import pack_longs, unpack_floats, unpack_longs
from annora.index import VectorIndex
from annora.operators import graph as G
from annora.operators.knn import knn_exact
from annora.operators.metavec import meta_vectors, refreshed, stratum


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")


def normal(n, dim, seed=42):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


def test_encode_micro_fixture():
    codes, sq, l1 = kernels.encode(np.array([[1.5, 1.5, 3.5, 3.5]], np.float32), np.array([1, 2, 3, 4], np.float32))
    assert codes.tobytes() == b"\x05" and sq[0] == 1.0 and l1[0] == 2.0


def test_zero_residual_estimates_its_own_norm():
    c = np.ones(4, np.float32)
    codes, sq, l1 = kernels.encode(c[None], c)
    assert kernels.estimates(np.arange(4), c, kernels.signs(codes, 4), sq, l1)[0] == 0.0


def test_quantized_order():
    v = normal(1000, 128)
    c = v.mean(0)
    codes, sq, l1 = kernels.encode(v, c)
    est = kernels.estimates(v[0], c, kernels.signs(codes, 128), sq, l1)
    exact = set(np.argsort(kernels.l2_to(v[0], v))[:10])
    assert len(exact & set(np.argsort(est)[:50])) >= 6


@pytest.mark.parametrize("n", [1, 2, 100, 500])
def test_graph_is_bounded_and_connected(n):
    v = normal(n, 32)
    graph, start = kernels.build_graph(v, degree=16, search_list=32, passes=2, alpha=1.2, seed=1)
    assert max(map(len, graph)) <= 16 and kernels.reached(graph, start).all()


def test_knn_matches_brute_force(spark):
    v = normal(300, 16)
    found = {(r.query_id, r["rank"]): r.id for r in knn_exact(frame(spark, v), frame(spark, v[:5]), 4).collect()}
    for q in range(5):
        assert [found[q, i] for i in range(1, 5)] == np.argsort(kernels.l2_to(v[q], v), kind="stable")[:4].tolist()
    with pytest.raises(ValueError):
        knn_exact(frame(spark, v), frame(spark, v), 0)
    assert knn_exact(frame(spark, v), frame(spark, v[:0]), 3).count() == 0


def test_index_life_cycle(spark, tmp_path):
    v = normal(655, 32)
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(exact_up_to=0, rerank_top_n=120, ef_search=120, max_degree=24, search_list=48, shard_rows=400))
    with pytest.raises(RuntimeError):
        index.search(frame(spark, v[:1]), 1)
    assert index.count() == 0 and not index.needs_rebuild()
    index.build(frame(spark, v[:500]))
    assert index.count() == 500 and not index.needs_rebuild()
    index.insert(frame(spark, v[500:], 500))
    assert index.count() == 655 and index.needs_rebuild()
    found = [(r.query_id, r.id) for r in index.search(frame(spark, v[:50]), 10).collect()]
    exact = {(q, int(i)) for q in range(50) for i in np.argsort(kernels.l2_to(v[q], v))[:10]}
    assert len(exact & set(found)) / 500 >= 0.9
    index.insert(frame(spark, v[:3]))  # known ids are replaced
    assert index.count() == 655
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert again.count() == 655
    again.rebuild_async(frame(spark, v)).result(120)
    assert again.count() == 655 and not again.needs_rebuild()
    with pytest.raises(Exception, match="bad vector"):
        again.insert(spark.createDataFrame([(9999, [1.0])], "vec_id long, embedding array<float>"))


def test_streaming_ingest(spark, tmp_path):
    from annora.streaming.ingest import ingest

    v = normal(60, 8)
    index = VectorIndex(spark, str(tmp_path / "s"))
    index.build(frame(spark, v[:40]))
    frame(spark, v[40:], 40).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(str(tmp_path / "in"))
    ingest(stream, index, str(tmp_path / "c")).awaitTermination(120)
    assert index.count() == 60


SMALL = IndexConfig(exact_up_to=0, rerank_top_n=64, ef_search=128, max_degree=24, search_list=48)


def near(v, q, k):
    return set(np.lexsort((np.arange(len(v)), kernels.l2_to(q, v)))[:k].tolist())


def share(spark, index, v, queries, k=10):
    found = {}
    for r in index.search(frame(spark, v[queries]), k).collect():
        found.setdefault(queries[r.query_id], set()).add(r.id)
    return sum(len(near(v, v[q], k) & found[q]) for q in queries) / (k * len(queries))


def test_pruning_many_is_pruning_each():
    v, rng = normal(300, 8), np.random.default_rng(1)
    pools = [rng.choice(300, rng.integers(1, 60)) for _ in range(300)]
    assert kernels.prune_many(np.arange(300), pools, v, 1.2, 8) == [kernels.robust_prune(i, p, v, 1.2, 8) for i, p in enumerate(pools)]
    same = np.zeros((40, 4), np.float32)
    graph, start = kernels.build_graph(same, degree=6, search_list=10, passes=2, alpha=1.2, seed=1)
    assert max(map(len, graph)) <= 6 and kernels.reached(graph, start).all()


@pytest.mark.parametrize("dim", [64, 128, 512])
def test_estimates_follow_distances(dim):
    v = normal(800, dim)
    c = v.mean(0)
    codes, sq, l1 = kernels.encode(v, c)
    sign, rho, below = kernels.signs(codes, dim), [], 0
    for q in range(0, 800, 40):
        est, true = kernels.estimates(v[q], c, sign, sq, l1), kernels.l2_to(v[q], v)
        below += (est < 0).sum()
        d = est.argsort().argsort() - true.argsort().argsort()
        rho.append(1 - 6 * (d.astype(float) ** 2).sum() / (800 * (800**2 - 1)))
    assert np.mean(rho) >= 0.8 and below <= 0.01 * 20 * 800


def test_search_after_build_and_insert(spark, tmp_path):
    """The beam is far smaller than the index, which is in several shards; codes are what it goes by."""
    v = normal(1200, 32)
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(exact_up_to=0, rerank_top_n=100, ef_search=128, max_degree=32, search_list=64, shard_rows=700))
    index.build(frame(spark, v[:800]))
    assert index.meta().shards == 3 and share(spark, index, v[:800], list(range(0, 800, 25))) >= 0.9
    index.insert(frame(spark, v[800:], 800))
    assert index.meta().shards == 4 and share(spark, index, v, list(range(0, 1200, 30))) >= 0.9
    nodes = index.nodes()
    sizes = [r["count"] for r in nodes.groupBy("shard").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 700
    assert G.reachable(nodes).first() == (1200, 1200) and G.degree_stats(nodes, 32).first().over == 0
    assert nodes.select("node_id").distinct().count() == 1200 and index.max_node_id() == 1199
    plan = index.search(frame(spark, v[:2]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard" not in plan and "MapInArrow" in plan
    found = G.by_shard(nodes.withColumn("code", F.expr("unhex(repeat('00', 4))")), lambda s, rows: rows.select(["shard"]).combine_chunks().to_batches()[0], "shard int")
    assert found.count() == 1200
    one = nodes.where("shard = 0").withColumn("code", F.expr("unhex(repeat('00', 4))"))
    center, q = np.array(index.meta().centroid, np.float32), frame(spark, v[:20])
    order = [[(r.query_id, r.id) for r in G.graph_search(n, q, center, 10, IndexConfig(rerank_top_n=10, ef_search=10, max_degree=32)).collect()] for n in (one, nodes.where("shard = 0"))]
    assert order[0] != order[1]


def test_only_touched_shards_are_written(spark, tmp_path):
    v = normal(400, 8)
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(shard_rows=110, max_degree=8, search_list=16))
    index.build(frame(spark, v))
    before, was = index.meta(), {r.id: r.node_id for r in index.nodes().select("id", "node_id").collect()}
    index.insert(frame(spark, v[:1] + 1, 7))
    after = index.meta()
    (first,), (new,) = before.folders, set(after.folders) - set(before.folders)
    assert len(after.folders[new]) == 1 and set(after.folders[first]) == set(before.folders[first]) - set(after.folders[new])
    now = {r.id: r.node_id for r in index.nodes().select("id", "node_id").collect()}
    assert now == was | {7: 400} and index.count() == 400 and index.max_node_id() == 400
    assert np.allclose(index.lookup([7]).first().vector, v[0] + 1) and index.lookup([999]).count() == 0
    assert index.lookup_nodes([400, was[9]]).count() == 2 and len(index.nodes().where("id = 7").first().neighbors) > 0
    true = np.concatenate([v[:7], v[:1] + 1, v[8:]]).mean(0)
    t = index.tracker()
    assert np.allclose(t.current, true, atol=1e-5) and t.inserts_since == 0 and t.reset().drift < 1e-6 and t.add(v[:5]).count == 405
    assert index.vacuum() == [] and index.count() == 400
    index.build(frame(spark, v))
    assert set(index.vacuum()) == {first, new} and index.nodes().count() == 400


def test_inserts_and_rebuilds_at_the_same_time(spark, tmp_path):
    v = normal(400, 8)
    index = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(max_degree=8, search_list=16))
    index.build(frame(spark, v[:40]))
    rebuild = index.rebuild_async(frame(spark, v[:200]))
    index.insert(frame(spark, v[300:303], 300))
    rebuild.result(120)
    assert {r.id for r in index.nodes().collect()} == {*range(200), 300, 301, 302}
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: index.insert(frame(spark, v[310 + i : 311 + i], 310 + i)), range(3)))
    assert index.count() == index.nodes().count() == 206
    gone = index.rebuild_async(frame(spark, v).withColumn("vec_id", F.expr("vec_id + length(reflect('java.lang.Thread', 'sleep', 300000L))")))
    for _ in range(100):
        if spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        threading.Event().wait(0.1)
    gone.cancel()
    with pytest.raises(Exception):  # noqa: B017
        gone.result(60)
    assert index.count() == 206


def test_many_searches_at_once(spark, tmp_path):
    v = normal(300, 16)
    index = VectorIndex(spark, str(tmp_path / "i"), SMALL)
    index.build(frame(spark, v))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda i: [r.id for r in index.search(frame(spark, v[i : i + 1], i), 5).collect()], range(8)))
    assert [f[0] for f in found] == list(range(8))
    assert index.warm(2) > 20
    index.close()
    hop = {r.node_id: r.hop for r in G.within_hops(index.nodes(), 1).collect()}
    entry = index.nodes().where("entry").first()
    assert hop == {entry.node_id: 0} | dict.fromkeys(entry.neighbors, 1)
    changed = G.with_neighbours(index.nodes(), spark.createDataFrame([(5, [1, 2])], "node_id long, neighbors array<long>"))
    assert changed.where("node_id = 5").first().neighbors == [1, 2] and changed.count() == 300


def test_threshold_between_exact_and_graph(spark, tmp_path):
    v = normal(300, 16)
    exact = VectorIndex(spark, str(tmp_path / "i"), IndexConfig(exact_up_to=301, max_degree=16, search_list=32))
    exact.build(frame(spark, v))
    assert share(spark, exact, v, list(range(0, 300, 20))) == 1.0
    graph = VectorIndex(spark, str(tmp_path / "i"), SMALL)
    assert share(spark, graph, v, list(range(0, 300, 20))) >= 0.9
    found = graph.search(frame(spark, v[:3]), 4).collect()
    assert all(r.score >= 0 for r in found) and len(found) == 12


def test_last_write_by_order_column(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 5), (1, [2.0, 0.0], 9), (1, [3.0, 0.0], 7), (2, [0.0, 1.0], 1)]
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>, at int").repartition(3), order="at")
    assert index.count() == 2 and index.lookup([1]).first().vector == [2.0, 0.0]
    index.insert(spark.createDataFrame([(1, [4.0, 0.0], 2), (1, [5.0, 0.0], 1)], "vec_id long, embedding array<float>, at int"), order="at")
    assert index.count() == 2 and index.lookup([1]).first().vector == [4.0, 0.0]


def test_recovery(spark, tmp_path):
    v = normal(60, 8)
    path = tmp_path / "i"
    index = VectorIndex(spark, str(path))
    assert index.count() == 0 and index.max_node_id() == -1
    index.build(frame(spark, v[:50]))
    (path / "commits" / "000000000007.json").write_text("not a record")
    assert index.count() == 50  # what can't be read is passed over, and its number isn't used again
    index.insert(frame(spark, v[50:], 50))
    assert index.count() == index.nodes().count() == 60 and (path / "commits" / "000000000008.json").exists()
    data = next((path / "data" / next(iter(index.meta().folders))).glob("shard=*/*.parquet"))
    data.write_bytes(data.read_bytes()[:16])
    with pytest.raises(Exception):  # noqa: B017
        index.search(frame(spark, v[:1]), 3).collect()
    data.unlink()
    assert index.search(frame(spark, v[:1]), 3).collect() == []
    for record in (path / "commits").iterdir():
        record.unlink()
    for again in (index.insert, lambda x: index.search(x, 1)):
        with pytest.raises(RuntimeError):
            again(frame(spark, v[:10]))
    index.build(frame(spark, v))
    assert index.count() == 60 and len(index.search(frame(spark, v[:1]), 3).collect()) == 3


def test_exact_search_with_ties_and_many_queries(spark):
    v = np.round(normal(500, 2)).astype(np.float32)
    many = np.concatenate([v] * 12)
    found = {}
    for r in knn_exact(frame(spark, v).repartition(3), frame(spark, many), 6, block_bytes=100_000).collect():
        found.setdefault(r.query_id, []).append(r.id)
    for q in range(0, len(many), 97):
        assert found[q] == np.lexsort((np.arange(500), kernels.l2_to(many[q], v)))[:6].tolist()
    assert len(found) == len(many)
    few = knn_exact(frame(spark, v[:3]), frame(spark, v[:2]), 10).collect()
    assert len(few) == 6


def test_strata_grow_with_their_index(spark):
    v = normal(80, 4)
    objects = frame(spark, v[:10])
    for known in (2, 60):
        old = stratum(frame(spark, v[:known]), objects, 5)
        new = {r.vec_id: r.s for r in refreshed(old, frame(spark, v[60:], 60), objects, 5, known).collect()}
        whole = {r.vec_id: r.s for r in stratum(frame(spark, np.concatenate([v[:known], v[60:]])), objects, 5).collect()}
        assert new.keys() == whole.keys() and all(np.allclose(new[i], whole[i]) for i in whole)
    both = meta_vectors(objects, [(old, 0.5), (old.where("vec_id < 4"), 2.0)]).collect()
    assert {r.vec_id for r in both} == {0, 1, 2, 3} and all(len(r.embedding) == 14 for r in both)


def test_codec(spark):
    rows = spark.createDataFrame([([1, -2],), ([],), (None,)], "x array<long>")
    got = [r.y for r in rows.select(unpack_longs(pack_longs("x")).alias("y")).collect()]
    assert got == [[1, -2], [], None]
    assert [r.b.hex() for r in rows.limit(1).select(pack_longs("x").alias("b")).collect()] == ["0100000000000000feffffffffffffff"]
    assert spark.sql("SELECT unhex('0000803F00') AS b").select(unpack_floats("b").alias("y")).first().y is None
    assert spark.sql("SELECT unhex('0000803F') AS b").select(unpack_floats("b").alias("y")).first().y == [1.0]


def test_linear_hashing():
    for old in range(1, 20):
        for new in range(old, 40):
            split = G.split_shards(old, new)
            assert set().union(*split.values(), set()) == set(range(old, new)) and all(p < old for p in split)
