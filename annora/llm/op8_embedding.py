"""Embedding near-dedup with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annora.llm.common import components, stored


def train_half(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of one half of the sampled vectors."""
    rng = np.random.default_rng(seed)
    centres = np.unique(rows[rng.permutation(len(rows))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        d = (centres**2).sum(1) - 2 * rows @ centres.T
        near = d.argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = rows[near == j].mean(0)
    return np.unique(centres, axis=0)


def lower_bounds(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far (squared) a row is at least from anything in the cell of each centre.

    What lies in another cell lies beyond the plane halfway between the two centres.
    """
    d = ((rows[:, None, :] - centres[None]) ** 2).sum(2) if len(rows) * centres.size < 1 << 24 else np.stack([((rows - c) ** 2).sum(1) for c in centres], 1)
    home = d.argmin(1)
    apart = np.sqrt(((centres[:, None, :] - centres[None]) ** 2).sum(2))[home]
    gap = np.maximum(d - d[np.arange(len(rows)), home][:, None], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(apart > 0, gap / (2 * apart), 0.0)
    return home, bound**2


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending order of first[i] + second[j], while that is reach at most; a heap merges the two sorted sequences."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > reach:
            return
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double; scaled first, so that no square overflows or vanishes."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Of two unit rows, summed exactly, so that it doesn't depend on what is computed beside it."""
    return math.fsum((x * y).tolist())


def _rated(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, fine, rid) of every row: fine tells whether it can link, rid is the hash of label and vector."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite
    return rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("rid", F.xxhash64("label", "v"))


@dataclass(frozen=True)
class Grid:
    """Two codebooks, and how far (squared) a cell may be to be looked into."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def places(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return *lower_bounds(units[:, :half], self.first), *lower_bounds(units[:, half:], self.second)


def cells_for(rows: int, sample: int) -> int:
    """Centres of a codebook: the grid's cells grow with the rows of the largest label, as far as the sample can tell centres apart."""
    return int(min(max(4, round((rows / 32) ** 0.5)), 256, max(4, sample // 16)))


def fit_grid(reps: DataFrame, *, threshold: float, target_recall: float, cells: int, max_rows: int, seed: int) -> Grid | None:
    """Codebooks of cells centres for the halves of unit vectors, from max_rows sampled rows at most; the commonest length decides.

    The reach for target_recall is found by trial: each sampled vector is turned by the threshold's angle in a random direction, and
    the reach is what leads that share of them to the cell of what they were turned into. At 1, it is what none can be beyond.
    """
    rows = [r.v for r in reps.orderBy(F.xxhash64(F.lit(seed), "rid"), "rid").limit(max_rows).select("v").collect()]
    if not rows:
        return None
    dim = int(pd.Series([len(r) for r in rows]).mode().iloc[0])
    m = unit_rows(np.array([r for r in rows if len(r) == dim]))
    half = dim // 2
    reach = 2 - 2 * threshold + 1e-9
    grid = Grid(train_half(m[:, :half], cells, seed), train_half(m[:, half:], cells, seed + 1), reach)
    if target_recall >= 1 or dim < 2:
        return grid
    u = np.random.default_rng(seed).standard_normal(m.shape)
    u -= (u * m).sum(1, keepdims=True) * m
    turned = threshold * m + math.sqrt(max(0.0, 1 - threshold**2)) * unit_rows(u)
    _, b1, _, b2 = grid.places(m)
    h1, _, h2, _ = grid.places(turned)
    at = np.arange(len(m))
    return Grid(grid.first, grid.second, min(reach, float(np.quantile(b1[at, h1] + b2[at, h2], target_recall)) + 1e-9))


def _postings(reps: DataFrame, shared) -> DataFrame:
    """A row for the cell that a vector is in (home), with the cells that it looks into, and one for each of these."""
    kind = reps.schema["v"].dataType.simpleString()
    schema = f"label string, dim int, cell int, home boolean, own int, looks array<int>, rid long, copies long, v {kind}"
    names = ["label", "dim", "cell", "home", "own", "looks", "rid", "copies", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                v = batch.column(3)
                size = np.fromiter((x.as_py() for x in pc.list_value_length(v)), np.int64, len(v))
                own, looks = np.zeros(len(v), np.int32), [[0]] * len(v)
                like = np.flatnonzero(size == grid.first.shape[1] + grid.second.shape[1]) if grid else []
                if len(like):
                    m = unit_rows(v.take(pa.array(like)).flatten().to_numpy(zero_copy_only=False).reshape(len(like), -1))
                    h1, b1, h2, b2 = grid.places(m)
                    own[like] = h1 * len(grid.second) + h2
                    for r, i in enumerate(like):
                        looks[i] = [a * len(grid.second) + b for a, b in multi_sequence(b1[r], b2[r], grid.reach)]
                who = np.concatenate([np.arange(len(v)), np.repeat(np.arange(len(v)), [len(x) for x in looks])])
                home = pa.array(np.arange(len(who)) < len(v))
                cell = pa.array(np.concatenate([own, *looks]).astype(np.int32))
                of = pa.array(who)
                listed = pa.array(looks + [None] * (len(who) - len(v)), pa.list_(pa.int32()))
                columns = [batch.column(0).take(of), pa.array(size[who].astype(np.int32)), cell, home, pa.array(own[who]), listed, batch.column(1).take(of), batch.column(2).take(of), v.take(of)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return reps.select("label", "rid", "copies", "v").mapInArrow(run, schema)


def _compare(threshold: float):
    """Of one block of homes and one of lookers: links per vector, and a spanning forest of the links.

    A pair meets twice if each looks into the other's cell: then each counts its own link. If only one does, it counts for both.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, lookers = pdf[pdf.home], pdf[~pdf.home]
        if not len(homes) or not len(lookers):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64")})
        hid, lid = homes.rid.to_numpy(), lookers.rid.to_numpy()
        hv, lv = unit_rows(np.stack(homes.v.to_numpy())), unit_rows(np.stack(lookers.v.to_numpy()))
        sim = lv @ hv.T
        near = sim >= threshold
        for i, j in np.argwhere(np.abs(sim - threshold) < 1e-9):
            near[i, j] = cosine(lv[i], hv[j]) >= threshold
        near &= lid[:, None] != hid[None]
        links = near @ homes["copies"].to_numpy()
        owns, of = np.unique(lookers.own.to_numpy(), return_inverse=True)
        looked = np.stack([np.isin(owns, x) for x in homes.looks])
        hlinks = lookers["copies"].to_numpy() @ (near & ~looked[:, of].T)
        some, hung = near.any(1), near.any(0)
        near, lid, links = near[some], lid[some], links[some]
        high = np.iinfo(np.int64).max
        left, right = lid.copy(), hid.copy()
        while True:
            low = np.minimum(left, np.where(near, right[None], high).min(1, initial=high))
            lower = np.minimum(right, np.where(near, low[:, None], high).min(0, initial=high))
            if (low == left).all() and (lower == right).all():
                break
            left, right = low, lower
        return pd.DataFrame({"id": np.concatenate([lid, hid[hung]]), "links": np.concatenate([links, hlinks[hung]]), "other": np.concatenate([left, right[hung]])})

    return run


def embedding_duplicates(vectors: DataFrame, *, threshold: float = 0.98, target_recall: float = 0.999, cells: int | None = None, sample: int = 20_000, block: int = 2_048, seed: int = 3) -> DataFrame:
    """Vectors (vec_id, embedding, label) linked if their labels are equal and their cosine is threshold or more.

    Equal vectors of a label are one from the start. Codebooks for the two halves of unit vectors, fitted on a seeded sample of
    sample rows at most, make a grid of cells**2 (cells: as many as cells_for() says); every vector is filed in the cell of its
    nearest centres. Each vector looks into the cells that multi-sequence traversal gives, nearest first, up to the distance at which
    target_recall of vectors turned by the threshold's angle have been met (1: up to the one beyond which nothing can be). A pair
    is found if either looks into the other's cell. What meets is verified: no link is below the threshold. A cell is split into
    blocks of about block vectors, of homes and of lookers, and each pair of blocks is one task's work; it returns a count per
    vector and a spanning forest, not pairs.

    Edge cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
    nothing; vectors of other lengths link only among themselves; repeated rows are equal vectors (n_links counts rows); rows that
    share an id are vectors of their own; cosines within 1e-9 of the threshold are summed exactly; an empty table gives no rows;
    other columns are ignored.

    Returns vec_id, n_links, component_id (smallest vec_id that links reach), kept (vec_id = component_id; true for a null id).
    """
    rated = _rated(vectors)
    fine = rated.where("fine")
    reps = stored(fine.groupBy("rid", "label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")), "vectors-distinct")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = fit_grid(reps, threshold=threshold, target_recall=target_recall, cells=cells or cells_for(largest, sample), max_rows=sample, seed=seed)
    posted = stored(_postings(reps, vectors.sparkSession.sparkContext.broadcast(grid)), "vectors-posted")
    key = ["label", "dim", "cell"]
    sizes = posted.groupBy(*key).agg(F.ceil(F.count_if("home") / block).alias("hb"), F.ceil(F.count_if(~F.col("home")) / block).alias("lb")).where("hb > 0 and lb > 0")
    dealt = posted.join(sizes, key).withColumn("mine", F.pmod(F.xxhash64("rid"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("lb"))))
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), F.col("lb")).otherwise(F.col("hb")) - 1)))
    h, look = (F.when(F.col("home") == x, F.col("mine")).otherwise(F.col("theirs")) for x in (True, False))
    dealt = dealt.select(*key, h.alias("h"), look.alias("l"), "home", "own", "looks", "rid", "copies", "v")
    # Dealt by block, or all blocks of a cell would stay in the task that the sizes were looked up in.
    found = stored(dealt.repartition(*key, "h", "l").groupBy(*key, "h", "l").applyInPandas(_compare(threshold), "id long, links long, other long"), "vectors-links")
    part = stored(components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))), "vectors-parts")
    counted = found.groupBy(F.col("id").alias("rid")).agg(F.sum("links").alias("links"))
    known = reps.select("rid", "low", "copies").join(counted, "rid", "left").join(part.withColumnRenamed("node", "rid"), "rid", "left")
    known = stored(known.select("rid", "root", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-known")
    lowest = stored(known.where("root is not null").groupBy("root").agg(F.min("low").alias("least")), "vectors-lowest")
    placed = stored(known.join(lowest, "root", "left").select("rid", "n_links", F.coalesce("least", "low").alias("component_id")), "vectors-placed")
    members = fine.select("vec_id", "rid").join(placed, "rid").select("vec_id", "n_links", "component_id")
    alone = rated.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = members.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
