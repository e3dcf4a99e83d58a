"""Meta-vectors: a vector, followed by what searches on other indexes say about it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annora.config import IndexConfig
from annora.index import VectorIndex
from annora.operators.knn import knn_join
from annora.session import shared_dir


def _filled(scores, size: int):
    return F.slice(F.concat(scores, F.array_repeat(F.lit(0.0), size)), 1, size)


def _times(values: str, weight: float):
    return F.transform(values, lambda x: x * weight)


def stratum(vectors: DataFrame | VectorIndex, objects: DataFrame, size: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, s): the distances of the size nearest vectors, ascending; short ones are filled with zeros.

    Both sides may be large: vectors are compared all against all in blocks (`knn_join`), or, if an index is given, searched by its graph (`search_join`), whose columns
    have the same names.
    """
    found = vectors.search_join(objects, size) if isinstance(vectors, VectorIndex) else knn_join(vectors, objects, size, id_col=id_col, vec_col=vec_col)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"])
    return found.groupBy(F.col("query_id").alias(id_col)).agg(_filled(scores, size).alias("s"))


def refreshed(old: DataFrame, added: DataFrame, objects: DataFrame, size: int, known: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A stratum (id, s) made over known vectors, as it is with the vectors added: only these are searched, whatever their index holds.

    Rows change only where an added vector is nearer than the last that counted.
    """
    new = stratum(added, objects, size, id_col, vec_col).withColumnRenamed("s", "new")
    count = added.agg(F.count("*").alias("more"))
    both = old.join(new, id_col).crossJoin(count)
    merged = F.array_sort(F.concat(F.slice("s", 1, min(size, known)), F.slice("new", F.lit(1), F.least(F.col("more"), F.lit(size)).cast("int"))))
    return both.select(id_col, _filled(merged, size).alias("s"))


def meta_vectors(objects: DataFrame, strata: Sequence[tuple[DataFrame, float]], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """objects with each stratum (id, s) times its weight appended to the vector; objects that a stratum lacks are left out.

    Strata don't depend on each other, so that Spark runs their searches side by side; they meet in one shuffle.
    """
    parts = objects.select(id_col, F.lit(0).alias("pos"), F.transform(vec_col, lambda x: x.cast("double")).alias("part"))
    for pos, (s, weight) in enumerate(strata, 1):
        parts = parts.unionByName(s.select(id_col, F.lit(pos).alias("pos"), _times("s", weight).alias("part")))
    whole = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")).where(F.size("parts") == len(strata) + 1)
    return whole.select(id_col, F.flatten(F.transform("parts", lambda p: p["part"])).alias(vec_col))


def meta_levels(vectors: DataFrame, sizes: Sequence[int], weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding", config: IndexConfig | None = None) -> DataFrame:
    """vectors, each level of which is searched by the one before: level n appends to a vector of level n - 1 its sizes[n] smallest distances there.

    With a config each level is indexed with it, in the shared folder, and searched by its graph: the work is then that of a build and of a search per
    vector, not of all pairs.
    """
    spark = vectors.sparkSession
    shared = shared_dir(spark)
    level = vectors.select(id_col, vec_col)
    for size in sizes:
        searched = level
        if config:
            searched = VectorIndex(spark, f"{shared}/level-{uuid.uuid4().hex}", config, id_col=id_col, vec_col=vec_col)
            searched.build(level)
        level = meta_vectors(level, [(stratum(searched, level, size, id_col, vec_col), weight)], id_col, vec_col).checkpoint()
        if config:
            searched.store.remove("")
    return level
