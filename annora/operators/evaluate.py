"""Quality of approximate results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annora.operators.knn import every_pair, matrix_of, packed, unpacked
from annora.session import shared_dir


def recall(approx: DataFrame, exact: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """One row (recall): the mean share of the exact top k (query_id, rank, id) that is among the approximate top m (k if not given)."""
    want, have = exact.where(F.col("rank") <= k).select("query_id", "id"), approx.where(F.col("rank") <= (m or k)).select("query_id", "id")
    hits = want.join(have.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("r")).agg(F.avg("r").alias("recall"))


#: Rows of one query that a task ranks, about (24 bytes each).
RANKED = 1_000_000
#: Pairs that a task of spearman_of() holds, about (16 bytes each), pairs that it scores at a time, and rows that are sent to it at a time.
HELD, SCORED, SENT = 16 << 20, 1 << 14, 1024


def places(rows: DataFrame, value: str, name: str, id_col: str) -> DataFrame:
    """rows with the place (name, from 1) of each among its query_id's rows by value, ties by id_col.

    A query's rows are dealt to buckets between quantiles of value, so that no task ranks them all: a place is the number of rows in the
    buckets before and the place in its own. Rows of one value share a bucket. Values are not null.
    """
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("_n"), F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    dealt = rows.join(sizes, "query_id").withColumn("_bucket", F.when(F.col("_n") > RANKED, F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(0)).drop("_n", "_cuts")
    before = F.sum("_rows").over(Window.partitionBy("query_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ahead = dealt.groupBy("query_id", "_bucket").agg(F.count("*").alias("_rows")).select("query_id", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("query_id", "_bucket").orderBy(value, id_col))
    return dealt.withColumn("_own", own).join(ahead, ["query_id", "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def spearman(pairs: DataFrame, a: str, b: str, id_col: str = "id") -> DataFrame:
    """One row per query_id (rho): rank correlation of columns a and b by ordinal ranks, ties by id.

    A query's pairs are shuffled once, packed, and ranked in one task; where a query has more than RANKED of them, all are checkpointed and ranked in buckets (`places`).
    """
    rows = pairs.select("query_id", F.col(id_col).cast("long").alias(id_col), F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    most = rows.groupBy("query_id").count().agg(F.max("count")).first()[0]
    if (most or 0) <= RANKED:
        of = rows.schema["query_id"].dataType.simpleString()
        packs = rows.mapInArrow(_packed, f"query_id {of}, ids binary, a binary, b binary")
        return packs.groupBy("query_id").applyInArrow(_ranks_apart, f"query_id {of}, s double, n long").select("query_id", _rho().alias("rho"))
    shared_dir(pairs.sparkSession)
    both = places(places(rows.checkpoint(), a, "_pa", id_col), b, "_pb", id_col)
    d = both.select("query_id", (F.col("_pa") - F.col("_pb")).cast("double").alias("d")).groupBy("query_id").agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.count("*").alias("n"))
    return d.select("query_id", _rho().alias("rho"))


def _rho() -> Column:
    return 1 - 6 * F.col("s") / (F.col("n") * (F.col("n") * F.col("n") - 1))


def spearman_of(rows: DataFrame, queries: DataFrame, scores: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """One row per query_id (rho): rank correlation of two scores of all rows (id, v, ...) for each of queries (id, v), by ordinal ranks, ties by id.

    scores(query vectors, some rows) makes a matrix for each score. No pair is shuffled or stored: rows and queries are packed and checkpointed, and each task
    streams all rows past some queries, HELD pairs together, whose scores it makes, keeps and ranks. Beyond HELD / 4 rows, for which ranking alone takes most of a task's memory, pairs are made and ranked by spearman().
    """
    spark = rows.sparkSession
    rows, queries = (df.withColumn("id", F.col("id").cast("long")) for df in (rows, queries))
    n, asked = rows.count(), queries.count()
    if n > HELD // 4:
        return spearman(every_pair(rows, queries, scores, "a double, b double"), "a", "b")
    shared_dir(spark)
    blocks = max(1, -(-asked * n // HELD), min(asked, 4 * spark.sparkContext.defaultParallelism))
    stream = packed(rows, SENT).checkpoint().coalesce(1)
    some = packed(queries.repartition(blocks), max(1, asked)).select(F.col("pack").alias("asked")).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        for batch in batches:
            for pack, asked in zip(*batch.columns, strict=True):
                if (block := asked.as_py()) not in known:
                    who = unpacked(block)
                    known[block] = [0, who.column(0).to_numpy(), matrix_of(who.column(1)), np.empty(n, np.int64), *np.empty((2, len(who), n))]
                end, _, q, ids, a, b = known[block]
                own = unpacked(pack.as_buffer())
                ids[end : end + len(own)] = own.column(0).to_numpy()
                for at in range(0, len(own), step := max(1, SCORED // len(q))):
                    part = own.slice(at, step)
                    a[:, end + at : end + at + len(part)], b[:, end + at : end + at + len(part)] = scores(q, part)
                known[block][0] += len(own)
        for end, who, _, ids, a, b in known.values():
            first = np.argsort(ids[:end], kind="stable")
            s = [_apart(x[first], y[first]) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(s, pa.float64()), pa.array([end] * len(who), pa.int64())], names=["query_id", "s", "n"])

    met = stream.crossJoin(some.hint("shuffle_replicate_nl"))
    return met.mapInArrow(run, "query_id long, s double, n long").select("query_id", _rho().alias("rho"))


def _order(values: np.ndarray) -> np.ndarray:
    """The places of values, ascending, equal ones in their order."""
    order = np.argsort(values)
    ascending = values[order]
    return order if (ascending[1:] > ascending[:-1]).all() else np.argsort(values, kind="stable")


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """The sum of the squared differences of the ranks by a and by b, ties in their order."""
    place = np.empty(len(a), np.int64)
    place[_order(a)] = np.arange(len(a))
    apart = (place[_order(b)] - np.arange(len(a))).astype(float)
    return float(apart @ apart)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, ids, a, b): the rows of a query that follow each other in a batch, as bytes."""
    for batch in batches:
        if not len(batch):
            continue
        run = pc.run_end_encode(batch.column(0))
        begin = [0, *run.run_ends.to_pylist()]
        own = [c.to_numpy() for c in batch.columns[1:]]
        packs = ([pa.array([c[x:y].tobytes() for x, y in zip(begin, begin[1:], strict=False)], pa.binary()) for c in own])
        yield pa.RecordBatch.from_arrays([run.values, *packs], names=["query_id", "ids", "a", "b"])


def _ranks_apart(rows: pa.Table) -> pa.Table:
    """(query_id, s, n): the sum of the squared differences of ranks, and how many there are."""
    ids, a, b = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("ids", np.int64), ("a", float), ("b", float)))
    place = np.empty((2, len(ids)), np.int64)
    for at, values in zip(place, (a, b), strict=True):
        at[np.lexsort((ids, values))] = np.arange(len(ids))
    apart = (place[0] - place[1]).astype(float)
    return pa.table({"query_id": rows["query_id"].slice(0, 1), "s": pa.array([float(apart @ apart)]), "n": pa.array([len(ids)], pa.int64())})
