"""A stored table of one row per key, brought up to date bucket by bucket (S10, S15), and a ledger of batches.

Keys are dealt to a fixed number of buckets by hash.  An update reads the buckets it touches, writes their new contents
beside the old ones and then a manifest that names every bucket's folder; the manifest, written last under the next
number, is what makes the update count.  Untouched buckets keep their files, a failed update leaves nothing that is
read, and whoever reads by an older manifest still finds its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tachado.session import stored

BUCKETS = 64


class Folder:
    """Small files in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.hadoop.io.IOUtils

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]

    def has(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def text(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self._io.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A whole file or none: written under another name and renamed; one that is there already stays and is an error."""
        made = self.at(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.has(name) or not self._fs.rename(made, self.at(name)):
            self._fs.delete(made, False)
            raise FileExistsError(f"{self.root}/{name}: someone else wrote this version")


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    schema: str | None = None
    batch: int = -1


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest of a table (an empty one where there is no table), or that of a version."""
    folder = Folder(spark, f"{path}/manifests")
    known = sorted(int(n[:-5]) for n in folder.names() if n.endswith(".json") and n[:-5].isdigit())
    if not known:
        return Manifest()
    said = json.loads(folder.text(f"{known[-1] if version is None else version:08d}.json"))
    return Manifest(said["version"], said["buckets"], {int(k): v for k, v in said["folders"].items()}, said["schema"], said["batch"])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a stored table, now or as of a version."""
    now = manifest(spark, path, version)
    if now.schema is None:
        raise FileNotFoundError(f"{path}: no table is stored there")
    return _rows(spark, path, now, list(now.folders))


def _rows(spark: SparkSession, path: str, now: Manifest, buckets: list[int]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(now.schema))
    folders = [f"{path}/{now.folders[b]}" for b in buckets if b in now.folders]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
           batch: int | None = None) -> int:
    """Bring the table up to date with ``rows``; returns the version that now counts.

    ``merge`` takes old and new rows of the touched buckets together and gives one row per key, with the same columns.
    ``buckets`` counts when the table is made.  A ``batch`` number that the table has seen changes nothing, so a repeated
    micro-batch counts once.  One writer at a time: of two, the later one gets an error and the table stays whole.
    """
    spark, now = rows.sparkSession, manifest(rows.sparkSession, path)
    if batch is not None and batch <= now.batch:
        return now.version
    n = now.buckets if now.version else buckets
    bucket = F.pmod(F.hash(*keys), F.lit(n))
    rows = stored(rows)
    touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # numbers below ``buckets``
    both = rows if now.schema is None else _rows(spark, path, now, touched).unionByName(rows, allowMissingColumns=True)
    merged = merge(both)
    version, made = now.version + 1, f"data/{now.version + 1:08d}-{uuid.uuid4().hex}"
    folders = dict(now.folders)
    if touched:
        merged.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{made}")
        folders |= {b: f"{made}/_bucket={b}" for b in touched}
    Folder(spark, f"{path}/manifests").put(f"{version:08d}.json", json.dumps({
        "version": version, "buckets": n, "folders": folders, "schema": merged.schema.json(), "batch": now.batch if batch is None else batch}))
    return version


def newest(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps each key's row that is last by ``order`` (of equal ones the last by all values)."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and _sorts(rows.schema[c].dataType)]))
        return rows.groupBy(*keys).agg(last.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])
    return merge


def _sorts(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sorts(kind.elementType)
    return all(_sorts(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else not isinstance(kind, T.MapType)


class Ledger:
    """Which sinks have taken which batch, as one empty file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def once(self, sink: str, number: int, write: Callable[[], None]) -> None:
        """Let a sink write unless it is known to have taken this batch."""
        name = f"{sink}-{number:012d}"
        if not self.folder.has(name):
            write()
            self.folder.put(name, "")


def batch_files(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet files in a folder per batch: a batch that was half written is overwritten."""
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write
