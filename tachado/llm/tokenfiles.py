"""Token ids as flat files of unsigned integers, with 64-bit offsets of the documents, read back by memory mapping.

A folder holds, for each partition, ``<name>.bin`` (unsigned 16-bit ids, one document after the other), ``<name>.idx``
(64-bit starts of its documents in the file, and the end) and ``<name>.doc`` (64-bit document ids), all little-endian,
and ``parts.parquet`` with the names in order and the number of ids before each: the prefix sums of their lengths.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tachado.llm.encoding import Encoder
from tachado.llm.tables import pieces, shared_dir

#: Stands for a null document id.
NO_ID = np.iinfo(np.int64).min
PARTS = "part int, name string, docs bigint, ids bigint"
CHUNK = 2000


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, file: str, end_id: int, folder: str | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) by the tokenizer in ``file``, each document closed by ``end_id``.

    Documents lie in ascending order of doc_id over all files (null first; equal ids by a hash of their text), in ranges
    of ids of about equal size.  Null texts are empty, repeated rows are written each, other columns are ignored; an
    empty table gives no files.  A task writes under a name of its own and only the names of tasks that ended well are
    listed, so a lost or repeated task leaves nothing behind that is read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(file), TaskContext.get().partitionId()
        disk, at = _opened(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        close, starts, ids, out = np.array([end_id], "<u2").tobytes(), [0], [], None
        for batch in batches:
            for piece in pieces(batch, "text"):
                if out is None:
                    disk.create_dir(at, recursive=True)
                    out = disk.open_output_stream(f"{at}/{name}.bin")
                for got in encoder.encode(piece.column("text").to_pylist()):
                    out.write(got)
                    out.write(close)
                    starts.append(starts[-1] + len(got) // 2 + 1)
                ids.append(piece.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy())
        if out is not None:
            out.close()
            for kind, values in (("idx", np.array(starts, "<i8")), ("doc", np.concatenate(ids).astype("<i8"))):
                with disk.open_output_stream(f"{at}/{name}.{kind}") as f:
                    f.write(values.tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": [len(starts) - 1], "ids": [starts[-1]]})

    ordered = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions(
        "doc_id", "_tie").drop("_tie")
    made = sorted(ordered.mapInArrow(parts, PARTS).collect())  # one row a partition
    bases = np.concatenate(([0], np.cumsum([p["ids"] for p in made]))).astype(int).tolist()
    spark.createDataFrame([(i, p["name"], p["docs"], p["ids"], b) for i, (p, b) in enumerate(zip(made, bases))],
                          f"{PARTS}, base bigint").coalesce(1).write.parquet(f"{folder}/parts.parquet")
    return folder


def _ids(disk: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's integers: mapped into memory where the folder is mounted, else read."""
    if isinstance(disk, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with disk.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before), n_tokens, ids_crc32; ids too if asked for.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers, and so is ``ids``.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, at = _opened(folder)
        for batch in batches:
            for part in batch.to_pylist():
                path = f"{at}/{part['name']}"
                starts, doc, flat = _ids(disk, f"{path}.idx", "<i8"), _ids(disk, f"{path}.doc", "<i8"), _ids(disk, f"{path}.bin", "<u2")
                for a in range(0, part["docs"], CHUNK):
                    b = min(a + CHUNK, part["docs"])
                    each = [flat[x:y].astype("<u4").tobytes() for x, y in zip(starts[a:b].tolist(), starts[a + 1:b + 1].tolist())]
                    own = np.asarray(doc[a:b])
                    columns = {"doc_id": pa.array(own, mask=own == NO_ID), "start": pa.array(np.asarray(starts[a:b]) + part["base"]),
                               "n_tokens": pa.array(np.diff(starts[a:b + 1])), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(each, pa.binary())} if with_ids else {}))

    parts = spark.read.schema(f"{PARTS}, base bigint").parquet(f"{folder}/parts.parquet")
    n = max(1, parts.count())
    return parts.repartition(n).mapInArrow(
        rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
