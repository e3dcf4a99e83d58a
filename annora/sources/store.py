"""The versioned store of an index: Parquet folders, one file per shard, and a record per version that names the shards in use."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "shard int, node_id long, id long, vector array<float>, code binary, sq_norm double, l1_norm double, neighbors array<long>, entry boolean, copy boolean"
#: A shard's file is one row group, so that one task reads it whole.
ROW_GROUP = 1 << 30


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Meta:
    """What a version is: its settings and counters, the mean at build and the sum of all vectors, and the shards of each data folder.

    subs: how many shards each cell has; cells: their centres, none where ids alone deal; cell_rows: nodes of each cell. node_count
    counts vectors, next_id nodes, of which a vector at a boundary has two. batches: the last micro-batch of each stream.
    """

    dim: int
    max_degree: int
    subs: list[int]
    node_count: int
    next_id: int
    vectors_at_build: int
    centroid: list[float]
    total: list[float]
    built_at: str
    build: str
    folders: dict[str, list[int]] = field(default_factory=dict)
    cells: list[list[float]] = field(default_factory=list)
    cell_rows: list[int] = field(default_factory=list)
    boundary: float = 1.0
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def shards(self) -> int:
        return sum(self.subs)


class IndexStore:
    """path/data/<attempt>/shard=<s>/: nodes; path/commits/<version>.json: Meta, created once and never changed, which is the commit.

    Writers work in folders of their own and commit by renaming a whole record to the next number, which fails if that is there; readers
    take the newest record. One that was cut off or isn't a record was never committed, and is passed over; an error in reading one is an error. That
    holds on any file system that renames atomically and not over a file (HDFS); on a local one, in one process.
    """

    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _hadoop(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._hadoop("commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> Meta | None:
        fs, path = self._hadoop(f"commits/{version:012d}.json")
        try:
            stream = fs.open(path)
            try:
                return Meta(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileNotFoundException":
                raise
            return None  # vacuumed meanwhile
        except (ValueError, TypeError):
            return None

    def newest(self) -> tuple[int, Meta | None]:
        """The largest version number in use (-1: none), and the newest version that was committed; a writer on top of it commits the next number."""
        versions = self._versions()
        found = (m for v in reversed(versions) if (m := self._read(v)))
        return max(versions, default=-1), next(found, None)

    def meta(self, version: int) -> Meta:
        found = self._read(version)
        if found is None:
            raise RuntimeError(f"version {version} can't be read")
        return found

    def nodes(self, meta: Meta, shards: set[int] | None = None) -> DataFrame:
        """Nodes of a version, or of some of its shards; a shard is read by one task, in order of node_id."""
        found = None
        for folder, own in meta.folders.items():
            wanted = [s for s in own if shards is None or s in shards]
            if wanted:
                part = self.spark.read.schema(NODES).parquet(f"{self.path}/data/{folder}").where(F.col("shard").isin(wanted)).select(*NODES.replace(",", "").split()[::2])
                found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], NODES) if found is None else found

    def write(self, nodes: DataFrame) -> tuple[str, DataFrame]:
        """A new data folder with nodes, which are dealt by shard, and its rows."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        nodes.write.option("parquet.block.size", ROW_GROUP).partitionBy("shard").parquet(path)
        return folder, self.spark.read.schema(NODES).parquet(path)

    def scratch(self, df: DataFrame) -> tuple[str, DataFrame]:
        """df, written to a folder of its own and read again."""
        name = f"data/scratch-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        fs, path = self._hadoop(name)
        fs.delete(path, True)

    def commit(self, version: int, meta: Meta) -> None:
        fs, path = self._hadoop(f"commits/{version:012d}.json")
        with self._lock:
            if fs.exists(path):
                raise Conflict(version)
            _, new = self._hadoop(f"commits/new-{uuid.uuid4().hex}")
            stream = fs.create(new, False)
            try:
                stream.write(bytearray(json.dumps(asdict(meta)).encode()))
            finally:
                stream.close()
            if not fs.rename(new, path):
                fs.delete(new, False)
                raise Conflict(version)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the newest keep versions, and data folders that only removed ones name. Readers of those versions fail."""
        versions = self._versions()
        old, new = versions[:-keep], versions[-keep:]
        used = {f for v in new if (m := self._read(v)) for f in m.folders}
        gone = {f for v in old if (m := self._read(v)) for f in m.folders} - used
        for v in old:
            self.remove(f"commits/{v:012d}.json")
        for f in gone:
            self.remove(f"data/{f}")
        return sorted(gone)
