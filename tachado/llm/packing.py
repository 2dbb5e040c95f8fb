"""Packing along a space-filling curve.

A document's vector counts its ids in hashed buckets; a fixed projection takes it to a few dimensions, and the Hilbert
index of that point is its place on the curve.  Documents are range-sorted by place and laid end to end, so that a
sequence holds neighbours; running sums over the ranges say where each document lies, and sequences are cut anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tachado.llm.encoding import Encoder
from tachado.llm.tables import pieces, written

LENGTH = 1024
BUCKETS, DIMS, BITS, TIE_BITS = 1024, 4, 8, 20
#: Ids that one range of the curve holds, about: the unit that is sorted in a task.
RANGE_IDS = 8_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of ``points`` (integers below 2**bits) on the Hilbert curve through the grid."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns and reflections of the cells, the largest first
        low = bit - 1
        for i in range(n):
            turn = (x[i] & bit) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def places(ids: list[np.ndarray]) -> np.ndarray:
    """The place on the curve of documents given by their ids."""
    bucket = (mixed(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    signs = 1.0 - 2.0 * (mixed(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(1 << 32)) & np.uint64(1)).astype(float).reshape(BUCKETS, DIMS)
    vectors = np.sqrt(np.stack([np.bincount(bucket[x], minlength=BUCKETS) for x in ids]))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.clip((vectors @ signs + 3) / 6, 0, 1 - 1e-9)
    return hilbert((unit * (1 << BITS)).astype(np.int64))


def encoded(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """doc_id, key, n_tokens and ids (unsigned 16-bit, ``end_id`` last) of each row of ``docs`` (doc_id, text).

    ``key`` is the place on the curve, then bits of a hash of doc_id: copies share a place, and may be many.
    """
    close = np.array([end_id], "<u2").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(file)
        for batch in batches:
            for part in pieces(batch, "text"):
                raw = [x + close for x in encoder.encode(part.column("text").to_pylist())]
                own = part.column("doc_id").cast(pa.int64())
                tie = mixed(own.fill_null(0).to_numpy().astype(np.uint64)) >> np.uint64(64 - TIE_BITS)
                key = (places([np.frombuffer(x, "<u2") for x in raw]) << TIE_BITS) | tie.astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own, "key": pa.array(key), "n_tokens": pa.array([len(x) // 2 for x in raw], pa.int64()), "ids": pa.array(raw, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, key bigint, n_tokens bigint, ids binary")


def ranges(rows: DataFrame, size: int = RANGE_IDS) -> DataFrame:
    """``rows`` (key, n_tokens, ...) with ``part``, the range of the curve that the key lies in; ranges hold about ``size`` ids."""
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n = -(-total // size)
    cuts: list[float] = []
    if n > 1:
        wanted = [i / n for i in range(1, n)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key", wanted, 100 * n)).first()[0]))
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    cutter = Bucketizer(splits=[-float("inf"), *map(float, cuts), float("inf")], inputCol="_key", outputCol="_part")
    return cutter.transform(rows.withColumn("_key", F.col("key").cast("double"))).withColumn("part", F.col("_part").cast("int")).drop("_key", "_part")


def pack(docs: DataFrame, file: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Cut ``docs`` (doc_id, text) into sequences of ``length`` ids, neighbours on the curve together.

    One row per piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset (in the
    sequence, without gaps), ids (unsigned 32-bit).  Every sequence is full but the last, which alone needs padding.
    A null or empty text is ``end_id`` alone; rows of equal doc_id and text are packed each; other columns are ignored;
    an empty table gives no sequences.
    """
    rows = ranges(written(encoded(docs, file, end_id), "encoded"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a range
    before = dict(zip([t["part"] for t in totals], np.concatenate(([0], np.cumsum([t["n"] for t in totals]))).astype(int).tolist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            for piece in pieces(batch, "ids"):
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
                for row_part, doc, raw in zip(*(piece.column(k).to_pylist() for k in ("part", "doc_id", "ids"))):
                    if row_part != part:
                        part, at = row_part, before[row_part]
                    ids, start = np.frombuffer(raw, "<u2").astype("<u4"), 0
                    while start < len(ids):
                        n = min(len(ids) - start, length - at % length)
                        for k, v in zip(out, (doc, start, n, len(ids), at // length, at % length, ids[start:start + n].tobytes())):
                            out[k].append(v)
                        start, at = start + n, at + n
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    ordered = rows.repartition(max(1, len(totals)), "part").sortWithinPartitions("part", "key", "doc_id", F.xxhash64("ids"))
    return ordered.select("part", "doc_id", "ids").mapInArrow(
        cut, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
