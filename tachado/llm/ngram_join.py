"""Jaccard self-join on word n-grams by T-occurrence search.

Sets with a Jaccard similarity of at least ``percent`` share T of their n shingles.  In one order for all, the rarest
first, the first n - T + 1 shingles of either must meet: these short inverted lists are merged, and the long ones of the
common shingles are never scanned but probed for the documents that came up (DivideSkip).

Equal sets are one class.  The members of a list are first compared with its first class only, which is linear in the
list; most lists are settled by that, as all their members are then connected.  In those that are not, exactly the
members in different components are compared: as pairs in lists of a few, by a search inside blocks of bounded size in
longer ones.  So every link between different sets is found that a component depends on, and no list makes all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tachado.llm.components import components
from tachado.llm.tables import pieces, written
from tachado.llm.words import distinct, lowered, windows

SIZE, PERCENT = 3, 90
#: Counters of the sketch that orders shingles by rarity; the order decides speed, never the result.
CELLS_LOG2, SLICES = 22, 64
#: Members of a list up to which its open pairs are listed one by one.
FEW = 16
#: Shingles that one block of a search holds, about.
BLOCK_SHINGLES = 2_000_000
#: Documents that one task compares with a class, and ids that a broadcast may hold.
MEMBERS, BROADCAST_ROWS = 500, 1_000_000
#: Nodes from here on are texts that share their doc_id with another one.
OWN = 1 << 62


def shingles(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text, A-Z lower-cased; of all its words if they are fewer."""
    words, counts = lowered(texts)
    every, out, at = windows(words, size), [], 0
    for n in counts.tolist():
        out.append(distinct(every[at:at + n - size + 1] if n >= size else windows(words[at:at + n], n)) if n else words[:0])
        at += n
    return out


def required(n: int, percent: int = PERCENT) -> int:
    """The overlap without which a set of ``n`` has no partner."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def rarity(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """A rank of rarity for each cell of hashes, from counts over all documents: partial sketches, merged by slices."""
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        counts = np.zeros(1 << CELLS_LOG2, np.uint32)
        for batch in batches:
            for part in pieces(batch, "text"):
                cells = [s >> np.uint64(64 - CELLS_LOG2) for s in shingles(part.column("text").to_pylist(), size)]
                counts += np.bincount(np.concatenate(cells).astype(np.int64), minlength=1 << CELLS_LOG2).astype(np.uint32)
        if counts.any():
            low = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in low]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.uint64)
        ranks = [np.minimum(4 * np.log2(x + 1), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(sums, pa.int32()), "ranks": pa.array(ranks, pa.binary())})

    found = docs.select("text").mapInArrow(sketches, "slice int, counts binary").repartition("slice").mapInArrow(merged, "slice int, ranks binary")
    out = np.zeros((SLICES, (1 << CELLS_LOG2) // SLICES), np.uint8)
    for row in found.collect():  # one byte for each cell, whatever the input
        out[row["slice"]] = np.frombuffer(row["ranks"], np.uint8)
    return out.reshape(-1)


def sets(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, place (a hash of the text), n, the hash of its set, and its rarest shingles."""
    ranks = docs.sparkSession.sparkContext.broadcast(rarity(docs, size).tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks.value, np.uint8)
        for batch in batches:
            for part in pieces(batch, "text"):
                every = shingles(part.column("text").to_pylist(), size)
                rare = []
                for s in every:
                    order = np.argsort(rank[(s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)], kind="stable")
                    rare.append(s[order[:len(s) - required(len(s), percent) + 1 if len(s) else 0]].astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").cast(pa.int64()), "place": part.column("place"), "n": pa.array([len(s) for s in every], pa.int64()),
                    "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in every], pa.binary()),
                    "rare": pa.array(rare, pa.list_(pa.int64()))})

    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    return placed.mapInArrow(rows, "doc_id bigint, place bigint, n bigint, set binary, rare array<bigint>")


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that sends ``small`` to all tasks if it has at most ``BROADCAST_ROWS`` rows, and shuffles both if not."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def verified(docs: DataFrame, pairs: DataFrame, places: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, b) of class ids, those whose sets are linked.

    The texts of the second are streamed past the set of the first, in portions if there are many; a task holds one set.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("portions"))
    tails = pairs.join(heads, "a").select(F.col("b").alias("doc_id"), F.struct(
        F.col("a").alias("head"), F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"), F.lit(False).alias("first")).alias("to"))
    own = heads.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).select(
        "doc_id", F.struct(F.col("doc_id").alias("head"), "portion", F.lit(True).alias("first")).alias("to"))
    wanted = written(tails.unionByName(own).groupBy("doc_id").agg(F.collect_list("to").alias("to")).join(places, "doc_id"), "wanted")
    rows = joined(docs.select("doc_id", F.xxhash64("text").alias("place"), "text"), wanted, ["doc_id", "place"])
    sent = rows.select("doc_id", F.explode("to").alias("to"), "text").select("to.head", "to.portion", "to.first", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                every = shingles(part.column("text").to_pylist(), size)
                for h, p, first, doc, found in zip(*(part.column(c).to_pylist() for c in ("head", "portion", "first", "doc_id")), every):
                    if first:
                        head, own = (h, p), found
                    elif head == (h, p) and linked(own, found, percent):
                        out.append((h, doc))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return sent.repartition("head", "portion").sortWithinPartitions("head", "portion", F.desc("first")).mapInArrow(compare, "a bigint, b bigint")


class Lists:
    """Inverted lists of the sets of some members: for each shingle, who has it."""

    def __init__(self, every: list[np.ndarray], members: list[int]):
        flat = np.concatenate([every[i] for i in members])
        owner = np.repeat(np.array(members), [len(every[i]) for i in members])
        order = np.argsort(flat, kind="stable")
        self.shingle, self.start = np.unique(flat[order], return_index=True)
        self.start, self.owner = np.append(self.start, len(flat)), owner[order]


def divide_skip(query: np.ndarray, lists: Lists, percent: int = PERCENT, keep: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members that share ``keep`` or more of a query's short lists, how many they share, and the shingles of its long ones.

    A partner shares T shingles at least, so it is in all but few of the short lists that are left when the T - ``keep``
    longest are set aside; only the short ones are merged.
    """
    need = required(len(query), percent)
    at = np.minimum(np.searchsorted(lists.shingle, query), len(lists.shingle) - 1)
    mine = np.flatnonzero(lists.shingle[at] == query)
    if len(mine) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), query[:0]
    at = at[mine]
    order = np.argsort(lists.start[at + 1] - lists.start[at], kind="stable")
    cut = len(mine) - max(0, need - keep)
    short, rest = at[order[:cut]], query[mine[order[cut:]]]
    found, count = np.unique(np.concatenate([lists.owner[lists.start[k]:lists.start[k + 1]] for k in short.tolist()]), return_counts=True)
    enough = count + len(rest) >= need
    return found[enough], count[enough], rest


def searched(frame: pd.DataFrame, size: int, percent: int) -> list[tuple[int, int]]:
    """Links between members of a block pair that connect different components: a spanning part of them.

    Whoever comes up in the short lists and is in another component is looked for in the long ones: each is probed by a
    binary search of its shingle in the member's sorted set.
    """
    every = shingles(frame["text"].tolist(), size)
    ids, side = frame["doc_id"].tolist(), frame["side"].to_numpy()
    both = (side == 0).any() and (side == 1).any()
    component, root, out = frame["component"].tolist(), {c: c for c in frame["component"]}, []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    lists = Lists(every, [i for i in range(len(ids)) if not both or side[i] == 0])
    for q, query in enumerate(every):
        if both and side[q] == 0:
            continue
        found, count, rest = divide_skip(query, lists, percent)
        for i, n in zip(found.tolist(), count.tolist()):
            a, b = top(component[q]), top(component[i])
            if a == b:
                continue
            other = every[i]
            n += int((other[np.minimum(np.searchsorted(other, rest), len(other) - 1)] == rest).sum())
            if 100 * n >= percent * (len(query) + len(other) - n):
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[q]))
    return out


def in_blocks(docs: DataFrame, members: DataFrame, places: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between ``members`` (list, doc_id, n, component) of the same list that are in different components."""
    blocks = members.groupBy("list").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    # A member goes to each pair of blocks that its own is in: as first or second, or alone with itself.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, -1).when(own < j, 0).otherwise(1).alias("side")))
    dealt = members.join(blocks, "list").select("doc_id", "list", "component", F.explode(pair).alias("p")).select(
        "doc_id", F.struct("list", "p.i", "p.j", "p.side", "component").alias("to"))
    wanted = written(dealt.groupBy("doc_id").agg(F.collect_list("to").alias("to")).join(places, "doc_id"), "wanted")
    rows = joined(docs.select("doc_id", F.xxhash64("text").alias("place"), "text"), wanted, ["doc_id", "place"])
    sent = rows.select("doc_id", "text", F.explode("to").alias("to")).select("to.*", "doc_id", "text")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(searched(frame, size, percent), columns=["a", "b"]).astype("int64")

    return sent.groupBy("list", "i", "j").applyInPandas(search, "a bigint, b bigint")


def _twins(every: DataFrame, nulls: bool) -> tuple[DataFrame, int]:
    """(doc_id, place, node) of texts whose doc_id does not name them alone, with a number of their own, and how many.

    Of an id with several texts the one of the least hash keeps the id; with ``nulls`` texts without an id count too.
    """
    several = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most")
    twins = every.join(several, "doc_id").where("place <> least").select("doc_id", "place").distinct()
    if nulls:
        twins = twins.unionByName(every.where("doc_id IS NULL").select("doc_id", "place").distinct())
    own = F.xxhash64("doc_id", "place").bitwiseAND(F.lit(OWN - 1)).bitwiseOR(F.lit(OWN))
    twins = written(twins.withColumn("node", own), "twins")
    return twins, twins.count()


def _as_nodes(rows: DataFrame, twins: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, place, ...) with ``id``, the doc_id they had, and the node's number as doc_id."""
    rows = rows.withColumn("id", F.col("doc_id"))
    if not n:
        return rows
    to = twins.select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "node")
    met = rows.join(F.broadcast(to) if n <= BROADCAST_ROWS else to, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")), "left")
    return met.withColumn("doc_id", F.coalesce("node", "doc_id")).drop("_id", "_place", "node")


def linked_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    A document's set is that of its runs of ``size`` words, or of all its words if they are fewer; documents link when
    100 * intersection >= ``percent`` * union, and component_id is the smallest doc_id that links lead to, their own
    included.  Null, empty and blank texts have no shingles and link with nothing; rows of equal doc_id and text are one
    node, different texts of one doc_id (below 2^62) are different nodes, and each row is returned; a null doc_id takes
    no part and has a null component; other columns are ignored.
    """
    found, n = _linked(docs, size, percent, False)
    component = F.col("component")
    if n:  # a component's smallest doc_id may be that of a text with a number of its own
        low = found.where(F.col("node") >= OWN).groupBy("component").agg(F.min("id").alias("low"))
        found = found.join(F.broadcast(low) if n <= BROADCAST_ROWS else low, "component", "left")
        component = F.least("low", F.when(component < OWN, component))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _linked(docs: DataFrame, size: int, percent: int, nulls: bool) -> tuple[DataFrame, int]:
    """(id, place, n, node, component) of every row, both numbers of nodes, and how many nodes have a number of their own."""
    every = written(sets(docs, size, percent), "sets")
    twins, n_twins = _twins(every, nulls)
    every = _as_nodes(every, twins, n_twins)
    docs = _as_nodes(docs.select("doc_id", "text", F.xxhash64("text").alias("place")), twins, n_twins).select("doc_id", "text")
    able = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = able.groupBy("set").agg(F.min(F.struct("doc_id", "place")).alias("rep"))
    reps = written(able.join(classes, (able["set"] == classes["set"]) & (able["doc_id"] == F.col("rep.doc_id")) & (able["place"] == F.col("rep.place")))
                   .select(able["doc_id"], able["place"], able["n"], able["rare"]).dropDuplicates(["doc_id"]), "classes")
    places = reps.select("doc_id", "place")
    tokens = reps.select("doc_id", "n", F.explode("rare").alias("token"))
    heads = tokens.groupBy("token").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("head < last")
    lists = written(tokens.join(heads, "token").select("token", "doc_id", "n", "head", "size"), "lists")
    size_of = reps.select(F.col("doc_id").alias("head"), F.col("n").alias("head_n"))
    fit = fitting(F.col("n"), F.col("head_n"), percent)
    stars = lists.where("doc_id <> head").select(F.col("head"), "doc_id", "n").distinct().join(size_of, "head").where(fit)
    links = written(verified(docs, stars.select(F.col("head").alias("a"), F.col("doc_id").alias("b")), places, size, percent), "links")

    found = components(links)
    label = F.coalesce("component", "doc_id").alias("component")
    labelled = lists.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", "size", label)
    open_ = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"),
                                          F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark")).where("x < y")
    # Lists of the same members ask the same question; one of them is enough.
    open_ = open_.groupBy("members", "mark").agg(F.min("token").alias("token"))
    rest = written(labelled.join(open_.select("token"), "token"), "open")
    few = rest.where(F.col("size") <= FEW)
    left, right = (few.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n", "component"))) for side in ("a", "b"))
    pairs = left.join(right, "token").where("a_doc_id < b_doc_id AND a_component <> b_component").where(
        fitting(F.col("a_n"), F.col("b_n"), percent)).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()
    # A pair whose first member was compared with the second already is known not to link.
    pairs = pairs.join(stars.select(F.col("head").alias("a"), F.col("doc_id").alias("b")), ["a", "b"], "left_anti")
    more = verified(docs, written(pairs, "pairs"), places, size, percent)
    many = in_blocks(docs, rest.where(F.col("size") > FEW).select(F.col("token").alias("list"), "doc_id", "n", "component"), places, size, percent)
    whole = components(links.unionByName(more).unionByName(many))
    of_class = classes.join(whole.withColumnRenamed("node", "id"), F.col("rep.doc_id") == F.col("id"), "left").select(
        "set", F.coalesce("component", F.col("rep.doc_id")).alias("component"))
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component"))
    return every.select("id", "place", "doc_id", "n", "set").join(of_class, "set", "left").select(
        "id", "place", "n", F.col("doc_id").alias("node"), F.coalesce(component, "doc_id").alias("component")), n_twins


def fitting(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def first_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of several texts of it the one of the least hash.

    Rows without an id link as well and come last.  Of rows with the same doc_id and text one stays (any, where their
    other columns differ).  Rows without words link with nothing and all stay.
    """
    found, n = _linked(docs, size, percent, True)
    found = written(found, "found")
    stays = F.col("component")
    if n:
        mixed_ = found.where(F.col("node") >= OWN).select("component").distinct()
        chosen = found.join(mixed_, "component", "left_semi").groupBy("component").agg(
            F.min_by("node", F.struct(F.col("id").isNull(), "id", "place")).alias("chosen"))
        found = found.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, "component", "left")
        stays = F.coalesce("chosen", "component")
    able = found.where("n > 0")
    gone = written(able.where(F.col("node") != stays).select("id", "place").distinct(), "gone")
    again = written(able.where(F.col("node") == stays).groupBy("id", "place").count().where("count > 1").select("id", "place"), "again")
    placed = docs.withColumn("_place", F.xxhash64("text"))
    left = _matched(placed, gone, "left_anti")
    if again.isEmpty():
        return left.drop("_place")
    once = _matched(left, again, "left_semi").dropDuplicates(["doc_id", "_place"])
    return _matched(left, again, "left_anti").unionByName(once).drop("_place")


def _matched(rows: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """Rows (doc_id, _place, ...) that ``texts`` (id, place) name, or not; broadcast within bounds."""
    texts = texts.select(F.col("id").alias("_id"), F.col("place").alias("_at"))
    few = texts.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(texts) if few else texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_place") == F.col("_at")), how)
