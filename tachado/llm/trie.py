"""The trie of conversations' beginnings, by truncation peeling.

From the greatest depth upwards, conversations that end at a depth join the nodes that survived from below, equal ones
become one node, and each node gives up its last turn to become part of its parent.  Conversations are sorted by their
turns, so that whatever can become one lies together, and cut into ranges; each range is peeled by itself.  Only the nodes
on the way to a range's first and last conversation may go on in another range: these stay open and, with what they have
gathered, are peeled again as rows of their own, until one range holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tachado.llm.tables import written

#: Bytes of a turn's hash, which covers all turns before it too.
WIDTH = 16
#: Bytes of hashes and lengths that are peeled at once.
CHUNK_BYTES = 32 << 20
ITEMS = "path binary, lens binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
#: A row is a node that is done (path null), or one still open with what it has gathered and the conversations that end there.
MADE = ("chunk bigint, id binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends string, path binary, lens binary, ended array<bigint>")
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) by conversation: conv_id, ``ts``, an array of (turn, key, n) in order.

    ``key`` is a hash of role and text and ``n`` the text's code points; texts themselves are not shuffled.  Null roles
    and texts are empty; null turn numbers come first, equal ones are ordered by ``key``; rows without a conv_id are in
    no conversation; repeated rows are repeated turns; other columns are ignored.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    each = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", key.alias("key"), F.length(text).cast("bigint").alias("n")).alias("t"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))


def with_shared_heads(convs: DataFrame, base: Column, head: Column) -> DataFrame:
    """Conversations with their first ``head`` turns replaced by those of conversation ``base`` (all if fewer, none if absent)."""
    wanted = convs.select("conv_id", "ts", base.alias("_base"), head.alias("_head"))
    theirs = convs.select(F.col("conv_id").alias("_base"), F.col("ts").alias("_theirs"))
    own = F.slice("ts", F.col("_head") + 1, F.size("ts"))
    first = F.coalesce(F.slice("_theirs", F.lit(1), F.col("_head")), F.slice("ts", 1, 0))
    return wanted.join(theirs, "_base", "left").select("conv_id", F.concat(first, own).alias("ts"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's way through the trie: a hash per turn, each over the one before it and the turn's key."""
    for batch in batches:
        turns = batch.column("ts")
        flat = turns.flatten()
        keys, n = flat.field("key").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False).astype("<i8")
        paths, lens, at = [], [], 0
        for size in np.diff(turns.offsets.to_numpy()):
            way, last = [], b""
            for key in keys[at:at + size]:
                last = xxhash.xxh3_128_digest(last + key)
                way.append(last)
            paths.append(b"".join(way))
            lens.append(n[at:at + size].tobytes())
            at += size
        zero = np.zeros(batch.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.binary()), pa.array(lens, pa.binary()), batch.column("conv_id"), pa.array(zero + 1), *[pa.array(zero)] * 3],
            ["path", "lens", "conv_id", *SUMS])


class _Peeled:
    """Rows gathered while a range is peeled."""

    def __init__(self, chunk: int):
        self.chunk, self.rows = chunk, []

    def add(self, **columns) -> None:
        self.rows.append(columns)

    def batch(self) -> pa.RecordBatch:
        fields = [(name, {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[kind])
                  for name, kind in (f.split(" ") for f in MADE.split(", "))]
        size = [len(r["conv_id"]) for r in self.rows]
        columns = {"chunk": [np.full(n, self.chunk) for n in size]}
        for name, kind in fields[1:]:
            columns[name] = [r[name] if name in r else [None] * n for r, n in zip(self.rows, size)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(x, kind) for x in columns[name]]) for name, kind in fields], [name for name, _ in fields])


def peel(items: pa.Table, chunk: int, whole: bool, convs: bool) -> pa.RecordBatch | None:
    """Nodes of a range of items sorted by path; with ``whole`` none stays open, with ``convs`` the items are conversations."""
    paths, lens = (items.column(c).combine_chunks() for c in ("path", "lens"))
    paths = paths.cast(pa.large_binary())
    ends = np.frombuffer(paths.buffers()[1], np.int64)[paths.offset:paths.offset + len(paths) + 1] // WIDTH
    data = np.frombuffer(paths.buffers()[2] or b"", np.uint64).reshape(-1, 2) if ends[-1] else np.zeros((0, 2), np.uint64)
    raw = np.ascontiguousarray(data).tobytes()
    length = np.frombuffer(b"".join(lens.to_pylist()), "<i8")
    first, depth = ends[:-1], np.diff(ends)
    length_at = np.concatenate(([0], np.cumsum(depth)))
    own = {c: items.column(c).to_numpy() for c in ("conv_id", *SUMS)}
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    out, kept = _Peeled(chunk), None

    def ids(rep: np.ndarray, d: int) -> list[bytes | None]:
        if d < 0:
            return [None] * len(rep)
        if d == 0:
            return [b""] * len(rep)
        return [raw[WIDTH * x:WIDTH * (x + 1)] for x in (first[rep] + d - 1).tolist()]

    for d in range(int(depth.max()), -1, -1):
        new = order[bounds[d]:bounds[d + 1]]
        # What survived, then what ends here, brought back into the order of the items.
        rep = np.concatenate((kept["rep"], new)) if kept else new
        if not len(rep):
            continue
        place = np.argsort(rep, kind="stable")
        values = {c: (np.concatenate((kept[c], own[c][new])) if kept else own[c][new])[place] for c in own}
        ended = (np.concatenate((np.zeros(len(kept["rep"]), bool), np.ones(len(new), bool))) if kept else np.ones(len(new), bool))[place]
        came = np.concatenate((np.arange(len(kept["rep"])), np.full(len(new), -1)))[place] if kept else np.full(len(new), -1)
        rep = rep[place]
        if d:
            key = data[first[rep] + d - 1]
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        else:
            begin = np.zeros(1, np.int64)
        group = np.cumsum(np.bincount(begin, minlength=len(rep))) - 1
        head = rep[begin]
        node = {c: np.add.reduceat(values[c], begin) for c in SUMS}
        node["conv_id"] = np.minimum.reduceat(values["conv_id"], begin)
        if whole:
            is_open = np.zeros(len(head), bool)
        elif d == 0:
            is_open = np.ones(1, bool)
        else:
            is_open = np.zeros(len(head), bool)
            for edge in (0, len(depth) - 1):
                if depth[edge] >= d:
                    is_open |= (data[first[head] + d - 1] == data[first[edge] + d - 1]).all(axis=1)
        ended_ids, ended_group = values["conv_id"][ended], group[ended]
        cuts = np.searchsorted(ended_group, np.arange(len(head) + 1))
        if kept:  # the row of each survivor learns its parent, unless that stays open
            mine = came >= 0
            parent = np.zeros(len(kept["rep"]), np.int64)
            parent[came[mine]] = group[mine]
            kept["row"]["parent_conv_id"] = pa.array(node["conv_id"][parent], mask=is_open[parent])
        done = np.flatnonzero(~is_open)
        left = np.flatnonzero(is_open)
        if len(left):
            at = [(first[r], first[r] + d, length_at[r]) for r in head[left]]
            out.add(id=ids(head[left], d), depth=np.full(len(left), d), path=[raw[WIDTH * a:WIDTH * b] for a, b, _ in at],
                    lens=[length[x:x + d].tobytes() for *_, x in at], **{c: node[c][left] for c in own},
                    ended=[ended_ids[cuts[g]:cuts[g + 1]] if convs else None for g in left])
        if not len(done):
            kept = None
            continue
        own_length = length[length_at[head[done]] + d - 1] if d else np.zeros(len(done), np.int64)
        leaves = np.where(node["n_children"] > 0, node["n_leaves"], 1)[done]
        saved = node["saved_tokens"][done] + (node["n_convs"][done] - 1) * own_length
        digests = [_digest(ended_ids[cuts[g]:cuts[g + 1]]) for g in done] if convs else [None] * len(done)
        row = {"id": ids(head[done], d), "parent": ids(head[done], d - 1), "depth": np.full(len(done), d), "conv_id": node["conv_id"][done],
               "n_convs": node["n_convs"][done], "n_children": node["n_children"][done], "n_leaves": leaves, "saved_tokens": saved, "ends": digests}
        out.add(**row)
        kept = {"rep": head[done], "conv_id": row["conv_id"], "n_convs": row["n_convs"], "n_children": np.ones(len(done), np.int64),
                "n_leaves": leaves, "saved_tokens": saved, "row": out.rows[-1]}
    return out.batch()


def _digest(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest() if len(convs) else NO_ENDS


def _peeling(turn: int, whole: bool, limit: int):
    """Peel a partition in chunks of bounded size, each with a number of its own."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def peeled():
            return peel(pa.Table.from_batches(held), turn << 56 | part << 28 | k, whole, turn == 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= limit and not whole:
                yield peeled()
                k, held, size = k + 1, [], 0
        if held:
            yield peeled()

    return rows


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its lists of conversations, which come in order; only one list is in memory."""
    now, running, some = None, None, False

    def done():
        return pa.RecordBatch.from_pydict({"id": pa.array([now], pa.binary()), "ends": [running.hexdigest()]})

    for batch in batches:
        for node, convs in zip(batch.column("id").to_pylist(), batch.column("ended")):
            if node != now:
                if now is not None:
                    yield done()
                now, running, some = node, hashlib.sha256(), False
            running.update((("," if some else "") + ",".join(map(str, convs.values.to_pylist()))).encode())
            some = True
    if now is not None:
        yield done()


def nodes(convs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, ts): id, parent, depth and what is below them.

    Per node: ``conv_id`` the smallest conversation that begins with it and ``n_convs`` how many do, ``parent_conv_id``
    the parent's, ``n_children``, ``n_leaves`` childless nodes from it on, ``saved_tokens`` code points that one copy of
    each turn from it on saves, and ``ends`` the SHA-256 of the numbers of the conversations that end there.  The root has
    depth 0 and no text; conversations without turns end there.  Without conversations there are no nodes.  A
    conversation's numbers must be unique; turns are told apart by 128-bit hashes.

    A conversation is one row of 24 bytes a turn; ranges of the sorted rows are of bounded size whatever turns they
    share.  Only the digest over one node's conversations is a stream through one task, as SHA-256 demands.
    """
    items = convs.mapInArrow(_paths, ITEMS)
    cut = items.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    done, opened, whole, before = [], [], False, None
    while True:
        made = written(cut.mapInArrow(_peeling(len(done), whole, chunk_bytes), MADE), "peeled")
        done.append(made.where("path IS NULL"))
        opened.append(made.where("path IS NOT NULL"))
        size = opened[-1].agg(F.sum(F.length("path") + F.length("lens") + 64)).first()[0]
        if size is None:
            break
        # One range for what is left of a few ranges, and for ways so deep that cutting them again gains nothing.
        whole = size <= chunk_bytes or (before is not None and 2 * size > before)
        rest = opened[-1].select([f.split(" ")[0] for f in ITEMS.split(", ")])
        cut = (rest.coalesce(1) if whole else rest.repartitionByRange("path")).sortWithinPartitions("path")
        before = size
    found = reduce(DataFrame.unionByName, done)
    again = reduce(DataFrame.unionByName, done[1:]) if done[1:] else found.limit(0)
    still = reduce(DataFrame.unionByName, opened)
    # Who waits for an open node's number asks by its own range, so no number is asked for by more rows than a range has.
    numbers = still.select("chunk", F.col("id").alias("parent")).distinct().join(
        again.select(F.col("id").alias("parent"), F.col("conv_id").alias("_number")), "parent")
    waits = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    told = found.where(waits).join(numbers, ["chunk", "parent"]).withColumn("parent_conv_id", F.col("_number")).select(found.columns)
    every = found.where(~waits).unionByName(told)
    lists = opened[0].where(F.size("ended") > 0).select("id", "ended").repartition("id").sortWithinPartitions("id", F.get("ended", F.lit(0)))
    digests = lists.mapInArrow(_streamed, "id binary, ends string").withColumnRenamed("ends", "_ends")
    late = every.where("ends IS NULL").join(digests, "id", "left").withColumn("ends", F.coalesce("_ends", F.lit(NO_ENDS))).select(every.columns)
    return every.where("ends IS NOT NULL").unionByName(late).select(
        "id", "parent", "conv_id", "depth", "parent_conv_id", *SUMS, "ends")
