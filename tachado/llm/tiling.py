"""Benchmark decontamination by greedy string tiling.

A document that repeats a test item does so in runs of equal tokens, possibly in another order.  Windows of a few tokens
are joined by their running hash; from these seeds the longest matches are marked again and again, none over a token
already marked, and the share of the item's tokens under marks decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tachado.llm.tables import pieces

TOKEN = re.compile(r"\w+")
MIN_MATCH = 5
COVERAGE = 0.5
#: Test items that one pass holds in each task; a larger benchmark takes a pass over the documents for each block.
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def running(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``k`` ids, modulo 2**64; ids of 0 are of no test item."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        out = out * BASE + ids[i:i + len(out)]
    return out


#: Two prime moduli below 2**31 with a base each: a product fits in 64 bits, both together tell 62 bits apart.
MODULI = ((2147483647, 1000003), (2147483629, 998244353))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids, put together from windows of 1, 2, 4, ... ids."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    parts = []
    for prime, base in MODULI:
        p = np.uint64(prime)
        level, width, power, out, done, rest = ids % p, 1, base % prime, None, 0, size
        while True:
            if rest & 1:
                if out is None:
                    out = level
                else:
                    out = (out[:len(level) - done] * np.uint64(power) + level[done:]) % p
                done += width
            rest >>= 1
            if not rest:
                break
            level = (level[:-width] * np.uint64(power) + level[width:]) % p
            width, power = 2 * width, power * power % prime
        parts.append(out)
    return parts[0] << np.uint64(31) | parts[1]


def free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` places that are all free."""
    taken = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(taken[size:] == taken[:-size]) if len(free) >= size else np.zeros(0, np.int64)


def longest_run(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def tile(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in ``a``, start in ``b``, length): the longest first, then the earliest in ``b``, then in ``a``.

    Ids of 0 in ``a`` match nothing.  The greatest length at which unmarked windows of both agree is found by halving,
    all its tiles are marked in one walk, and the next length is shorter.  No pair of windows is ever listed, so
    text that repeats one token costs in proportion to its length.  Tokens under a mark have been compared one by one.
    """
    free_a, free_b, out = a != 0, np.ones(len(b), bool), []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of both sides whose hashes occur on the other side too: starts and hashes, by start."""
        at_a, at_b = free_windows(free_a, size), free_windows(free_b, size)
        h_a, h_b = window_hashes(a, size)[at_a], window_hashes(b, size)[at_b]
        in_a = np.isin(h_a, h_b)
        at_a, h_a = at_a[in_a], h_a[in_a]
        in_b = np.isin(h_b, h_a)
        return at_a, h_a, at_b[in_b], h_b[in_b]

    limit = len(b)
    while (limit := min(limit, longest_run(free_a), longest_run(free_b))) >= k:
        low, high = k - 1, limit
        while low < high:  # a match of some length holds matches of every shorter one
            middle = (low + high + 1) // 2
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < k:
            break
        at_a, h_a, at_b, h_b = shared(low)
        order = np.argsort(h_a, kind="stable")
        at_a, h_a = at_a[order], h_a[order]
        first, end = np.searchsorted(h_a, h_b, "left").tolist(), np.searchsorted(h_a, h_b, "right").tolist()
        next_of: dict[int, int] = {}  # by the first window of a hash: those before have a mark
        for j, x, y in zip(at_b.tolist(), first, end):
            if not (free_b[j] and free_b[j + low - 1]):
                continue
            at = next_of.get(x, x)
            while at < y and not (free_a[at_a[at]] and free_a[at_a[at] + low - 1]):
                at += 1
            next_of[x] = at
            if at < y and (a[(i := int(at_a[at])):i + low] == b[j:j + low]).all():
                free_a[i:i + low] = free_b[j:j + low] = False
                out.append((i, j, low))
        limit = low - 1
    return sorted(out, key=lambda t: t[1])


def spread(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``k`` from one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps)[:n] > 0


class Index:
    """The seeds of a block of test items: the distinct hashes, sorted, with the items that have each."""

    def __init__(self, items: list[tuple[int, str | None]], k: int):
        self.k, self.vocabulary = k, {}
        rows = [(item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.uint64))
                for item, text in items]
        self.items = [(item, ids) for item, ids in rows if len(ids)]
        #: Items shorter than a seed can only be found whole.
        self.short = defaultdict(list)
        hashes, owner = [], []
        for n, (_, ids) in enumerate(self.items):
            if len(ids) < k:
                self.short[len(ids)].append(n)
            h = running(ids, k)
            hashes.append(h)
            owner.append(np.full(len(h), n))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        #: Distinct hashes, and which of them each window of each item has (items end to end).
        self.hashes, self.which = np.unique(join(hashes, np.uint64), return_inverse=True)
        owner = join(owner, np.int64)
        self.ends = np.searchsorted(owner, np.arange(len(self.items) + 1))
        order = np.argsort(self.which, kind="stable")
        self.owner, self.begins = owner[order], np.searchsorted(self.which[order], np.arange(len(self.hashes) + 1))
        #: Most windows of a document are in no item; a bit for each low part of a hash says so at once.
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _met(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the document's windows that are in items, and which distinct window each is."""
        h = running(ids, self.k)
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero((known[self.k:] == known[:-self.k]) & self.bits[(h >> np.uint64(44)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[which] == h[at]
        return at[same], which[same]

    def matches(self, text: str | None, least: float) -> list[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """(item_id, item tokens, covered tokens, tiles) of each item covered to ``least`` or more; items without an id first."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        found = []
        if len(ids) >= self.k and len(self.hashes):
            at, which = self._met(ids)
            met = np.unique(which)
            touched = {n for x in met.tolist() for n in self.owner[self.begins[x]:self.begins[x + 1]].tolist()}
            for n in sorted(touched):
                item, b = self.items[n]
                windows = self.which[self.ends[n]:self.ends[n + 1]]
                if spread(np.flatnonzero(np.isin(windows, met)), self.k, len(b)).sum() < least * len(b):
                    continue
                # Only what lies under seeds of this item can be tiled; a 0 parts what is not next to each other.
                under = np.flatnonzero(spread(at[np.isin(which, windows)], self.k, len(ids)))
                gaps = np.flatnonzero(np.diff(under) > 1) + 1
                a, places = np.insert(ids[under], gaps, 0), np.insert(under, gaps, -1)
                tiles = [(int(places[i]), j, size) for i, j, size in tile(a, b, self.k)]
                if (covered := sum(t[2] for t in tiles)) >= least * len(b):
                    found.append((item, len(b), covered, tiles))
        for size, members in self.short.items():
            if len(ids) >= size:
                h = running(ids, size)
                for n in members:
                    item, b = self.items[n]
                    whole = next((i for i in np.flatnonzero(h == running(b, size)[0]).tolist() if (ids[i:i + size] == b).all()), None)
                    if whole is not None:
                        found.append((item, size, size, [(whole, 0, size)]))
        return sorted(found, key=lambda m: (m[0] is not None, m[0] or 0, m[1:]))


def blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most ``limit`` characters of text, or one item, in the order of item_id."""
    block, size = [], 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"] or "") > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    if block:
        yield block


MATCH = "array<struct<item_id:bigint,item_tokens:bigint,covered:bigint,tiles:array<struct<doc_start:bigint,item_start:bigint,length:bigint>>>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("covered", pa.int64()), (
    "tiles", pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])))]))


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` (doc_id, text) that hold test items: every column of the row, and ``matches``.

    ``items`` (item_id, text) is the benchmark; it is held in each task in blocks of bounded size.  Tokens are runs of
    letters and digits, lower-cased.  An item counts as held if tiles of ``min_match`` tokens or more cover ``coverage``
    of its tokens; shorter items must occur whole.  Null and empty texts, and items without tokens, match nothing; an item
    without an id is sought like any other and reported with a null ``item_id``;
    repeated rows are judged each; a column ``matches`` of the input is replaced; an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    docs = docs.drop("matches")
    out = None
    for block in blocks(items):
        held = spark.sparkContext.broadcast(block)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, matches {MATCH}"
        found = docs.mapInArrow(_finder(held, min_match, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return docs.limit(0).withColumn("matches", F.lit(None).cast(MATCH)) if out is None else out


def _finder(held, k: int, coverage: float, keep: str = "found"):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, k)
        for batch in batches:
            for part in pieces(batch, "text"):
                every = [index.matches(t, coverage) for t in part.column("text").to_pylist()]
                take = pa.array([bool(m) == (keep == "found") for m in every])
                rest = part.filter(take)
                if keep == "clean":
                    yield rest
                    continue
                listed = [[{"item_id": i, "item_tokens": n, "covered": c, "tiles": [
                    dict(zip(("doc_start", "item_start", "length"), t)) for t in ts]} for i, n, c, ts in m] for m in every if m]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(listed, _ARROW)], names=[*part.schema.names, "matches"])
    return rows


def clean(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without those that hold a test item; the rest as they are.  See ``contaminated``."""
    for block in blocks(items):
        docs = docs.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(block), min_match, coverage, "clean"), docs.schema)
    return docs


def pairs(found: DataFrame) -> DataFrame:
    """One row per document and item held: doc_id, item_id, item_tokens, covered, coverage, tiles."""
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", "m.item_tokens", "m.covered", (F.col("m.covered") / F.col("m.item_tokens")).alias("coverage"), "m.tiles")
