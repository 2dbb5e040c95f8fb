"""Substring deduplication with a count-min prefilter.

Every run of ``size`` words is a window.  The first pass counts windows in a sketch of one row of many cells: each chunk
of documents makes its own, sparse, as the sorted cells it touches, and the parts are merged by ranges of cells, so the
sketch may be wider than any machine.  A cell's count is never below that of a window in it.  Only windows whose cell
counts two or more are then grouped by their own hashes, and every one but the first in order is marked; windows seen
once anywhere never leave their chunk.

Texts are dealt to chunks once, and all passes read that one shuffle.  What travels besides is a few bytes for each
window, in blobs of a chunk and a range; no key gathers rows, however often a window repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tachado.llm.words import P, WordHashes, split, windows

SIZE = 20
#: Characters of text in a chunk, and windows in a range of cells or hashes, about.
CHUNK_CHARS, RANGE_WINDOWS = 4_000_000, 8_000_000
#: Cells for each character of the corpus, as a power of two: the share of windows that only seem repeated is about
#: one in 2**SPARE / 6 characters a word.
SPARE = 6


def planes(x: np.ndarray) -> bytes:
    """Integers as their lowest bytes, then the next and so on: those that are nearly all zero shrink in the shuffle."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def steps(x: np.ndarray) -> bytes:
    """A sorted array as its differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=np.uint64)


class Chunk:
    """The documents of a chunk in order, and their windows: a hash, 32 more bits, and the document of each."""

    def __init__(self, table: pa.Table, size: int):
        known, order = WordHashes(), table.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        ids = order.column("doc_id").combine_chunks().cast(pa.int64())
        self.doc_id = ids
        #: Null comes before every id.
        self.rank = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
        if ids.null_count:  # Arrow sorts null last
            turn = np.argsort(self.rank, kind="stable")
            order, self.rank, self.doc_id = order.take(pa.array(turn)), self.rank[turn], ids.take(pa.array(turn))
        self.size = size
        self.words = [split(t) for t in order.column("text").to_pylist()]
        hashes = [known.of(w) for w in self.words]
        counts = np.array([max(0, len(w) - size + 1) for w in self.words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.hash = np.concatenate([windows(h, size) for h in hashes]) if hashes else np.zeros(0, np.uint64)
        self.more = np.concatenate([windows(h, size, P[1]) for h in hashes]).astype(np.uint32) if hashes else np.zeros(0, np.uint32)
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def distinct(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows ``among``: the first of each kind, sorted by hash, and all that come after one in the chunk."""
        order = among[np.lexsort((among, self.more[among], self.hash[among]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order][1:] != self.hash[order][:-1]) | (self.more[order][1:] != self.more[order][:-1])
        return order[new], order[~new]

    def kept(self, marked: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """For each document the number of words and those outside of ``marked`` windows."""
        at = np.sort(marked)
        edges = np.searchsorted(at, self.first)
        for d, words in enumerate(self.words):
            starts = at[edges[d]:edges[d + 1]] - self.first[d]
            if not len(starts):
                yield len(words), words
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + self.size, -1)
            out = np.cumsum(depth[:-1]) == 0
            yield len(words), [words[i] for i in np.flatnonzero(out).tolist()]


def parts(x: np.ndarray, bits: int, ranges: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of a sorted array of ``bits``-bit integers, for the ranges that have some."""
    bounds = [np.uint64((r << bits) // ranges) for r in range(1, ranges)]
    edges = [0, *np.searchsorted(x, np.array(bounds, np.uint64)).tolist(), len(x)]
    return [(r, a, b) for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def cells_of(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted cells of a chunk's windows, whether more than one falls in it, and each window's place among them."""
    cells, place, count = np.unique(chunk.hash >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return cells, count > 1, place


SKETCH = "range int, chunk int, cells binary, twice binary"
ANSWER = "chunk int, range int, bits binary"
EXACT = "range int, chunk int, hash binary, more binary, doc binary, at binary"
MARKS = "chunk int, at binary"


def _table(columns: dict[str, list], *binary: str) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k in binary else pa.int32()) for k, v in columns.items()})


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and kept_text.

    Words are runs of characters other than blanks, as they are.  A word goes if a window of ``size`` words that covers it
    also starts earlier: in a document of a smaller doc_id (null is the smallest), or before in the same one; windows
    are judged on the input.  Kept words are joined by one space.  Null texts are empty; rows of equal doc_id are in order
    of a hash of their text, and of repeated rows one is the first; other columns are ignored.  Windows are told apart by
    96 bits of hash.  A chunk holds all rows of a doc_id.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, ranges = max(1, -(-chars // CHUNK_CHARS)), max(1, -(-chars // (6 * RANGE_WINDOWS)))
    bits = min(60, math.ceil(math.log2(chars + 2)) + SPARE)
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("place"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")).repartition("chunk")

    def sketch(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, size)
        cells, twice, _ = cells_of(chunk, bits)
        out: dict[str, list] = {"range": [], "chunk": [], "cells": [], "twice": []}
        for r, a, b in parts(cells, bits, ranges):
            for k, v in zip(out, (r, table.column("chunk")[0].as_py(), steps(cells[a:b]), np.packbits(twice[a:b]).tobytes())):
                out[k].append(v)
        return _table(out, "cells", "twice")

    def merge(table: pa.Table) -> pa.Table:
        own = [unsteps(raw) for raw in table.column("cells").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(raw, np.uint8), count=len(c)).astype(bool) for raw, c in zip(table.column("twice").to_pylist(), own)]
        every = np.sort(np.concatenate([*own, *(c[t] for c, t in zip(own, twice))]))
        often = np.unique(every[1:][every[1:] == every[:-1]])
        found = [_among(c, often) for c in own]
        return _table({"chunk": table.column("chunk").to_pylist(), "range": table.column("range").to_pylist(),
                       "bits": [np.packbits(x).tobytes() for x in found]}, "bits")

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"range": [], "chunk": [], "hash": [], "more": [], "doc": [], "at": []}
        if left.num_rows and right.num_rows:
            chunk = Chunk(left, size)
            cells, _, place = cells_of(chunk, bits)
            told, often = dict(zip(right.column("range").to_pylist(), right.column("bits").to_pylist())), np.zeros(len(cells), bool)
            for r, a, b in parts(cells, bits, ranges):
                often[a:b] = np.unpackbits(np.frombuffer(told[r], np.uint8), count=b - a)
            first, _ = chunk.distinct(np.flatnonzero(often[place]))
            hashes = chunk.hash[first]
            for r, a, b in parts(hashes, 64, ranges):
                at = first[a:b]
                for k, v in zip(out, (r, left.column("chunk")[0].as_py(), steps(hashes[a:b]), chunk.more[at].tobytes(),
                                      planes(chunk.rank[chunk.owner[at]].view(np.uint64)), planes(at.astype(np.uint64)))):
                    out[k].append(v)
        return _table(out, "hash", "more", "doc", "at")

    def group(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        hashes = [unsteps(raw) for raw in table.column("hash").to_pylist()]
        source = np.repeat(np.arange(len(chunk)), [len(h) for h in hashes])
        h, more = np.concatenate(hashes), np.concatenate([np.frombuffer(raw, np.uint32) for raw in table.column("more").to_pylist()])
        doc = np.concatenate([unplanes(raw) for raw in table.column("doc").to_pylist()]).view(np.int64)
        at = np.concatenate([unplanes(raw) for raw in table.column("at").to_pylist()])
        order = np.lexsort((doc, more, h))
        later = np.zeros(len(order), bool)
        later[1:] = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
        marked = order[later]
        marked = marked[np.lexsort((at[marked], source[marked]))]
        edges = np.searchsorted(source[marked], np.arange(len(chunk) + 1))
        out = [(c, steps(at[marked[a:b]])) for c, a, b in zip(chunk, edges, edges[1:]) if b > a]
        return _table({"chunk": [c for c, _ in out], "at": [x for _, x in out]}, "at")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        chunk = Chunk(left, size)
        _, again = chunk.distinct(np.arange(len(chunk.hash)))
        marked = np.concatenate([again, *(unsteps(raw).astype(np.int64) for raw in right.column("at").to_pylist())])
        n, kept = zip(*chunk.kept(np.unique(marked)))
        return pa.table({"doc_id": chunk.doc_id, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()),
                         "kept_text": pa.array([b" ".join(k).decode() for k in kept], pa.string())})

    answers = dealt.groupBy("chunk").applyInArrow(sketch, SKETCH).groupBy("range").applyInArrow(merge, ANSWER)
    exact = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(select, EXACT)
    marks = exact.groupBy("range").applyInArrow(group, MARKS)
    return dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _among(x: np.ndarray, often: np.ndarray) -> np.ndarray:
    if not len(often):
        return np.zeros(len(x), bool)
    return often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x
