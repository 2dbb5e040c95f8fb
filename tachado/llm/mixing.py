"""Sources mixed to target weights, by blocks of words drawn into shards.

Each source's words, its documents one after the other, are cut into blocks of fixed length.  Every shard of the output
draws by a multinomial how many of its slots each source fills; the slots of a source, counted over all shards, go through a
pseudorandom permutation of its block numbers, anew for each pass over the source, and blocks join slots by that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tachado.llm.ranks import ranked
from tachado.llm.tables import written
from tachado.llm.words import P, mixed

#: Words to a block, slots to a shard: a shard is a file of some 4 million words.
BLOCK, SLOTS = 256, 16_384
#: The most often that a source, and so a document, is taken.
PASSES = 3
#: Sources are rows of a table that the driver reads; more than these are refused.
SOURCES = 1_000_000


@dataclass(frozen=True)
class Plan:
    """One entry per source: its words and blocks, the words wanted, and the slots that give exactly these.

    ``cut`` is the number of words taken of the block in the last slot.
    """

    sources: list[str | None]
    words: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    cut: np.ndarray


def targets(sizes: np.ndarray, weights: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """The sum of ``sizes`` shared by weight, none above ``passes`` times its own; the excess is shared again by weight."""
    caps, out = passes * sizes.astype(float), np.zeros(len(sizes))
    free, left = np.ones(len(sizes), bool), float(sizes.sum())
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > caps)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Each ``index`` below ``size`` through a permutation of these numbers that ``key`` selects, or back.

    Four rounds of exchange between the halves of the number's bits; what falls outside goes through again.
    """
    half = np.array([(max(int(s) - 1, 1).bit_length() + 1) // 2 for s in np.unique(size)], np.uint64)[np.unique(size, return_inverse=True)[1]]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in (range(3, -1, -1) if back else range(4)):
            salt = k + P[turn]
            if back:
                left, right = right ^ (mixed(left + salt) & m), left
            else:
                left, right = right, left ^ (mixed(right + salt) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _key(seed: int, *parts: np.ndarray) -> np.ndarray:
    value = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
    return value


def planned(sources: list[str | None], words: np.ndarray, weights: np.ndarray, block: int = BLOCK, seed: int = 0) -> Plan:
    """Slots for each source's target, rounded down to whole words.

    Whole passes take every block; the last pass takes permuted blocks until the words are reached, where the one block
    that is shorter (the source's last) counts by its own length if its place comes before.
    """
    wanted = targets(words, weights)
    whole = np.floor(wanted + 1e-6 * np.minimum(wanted, 1)).astype(np.int64)
    blocks = -(-words // block)
    full = np.divide(whole, words, out=np.zeros(len(words)), where=words > 0).astype(np.int64)
    rest = whole - full * words
    last = np.where(words > 0, words - (blocks - 1) * block, 0)
    ok = blocks > 0
    place = np.zeros(len(words), np.int64)
    if ok.any():
        place[ok] = permuted(blocks[ok] - 1, blocks[ok], _key(seed, np.flatnonzero(ok), full[ok]), back=True)
    short = np.where(rest > place * block, block - last, 0)
    more = -(-(rest + short) // block)
    cut = rest - (more - 1) * block + np.where((rest > place * block) & (place < more - 1), short, 0)
    cut = np.where(more > 0, cut, block)
    return Plan(sources, words, wanted, blocks, full * blocks + more, cut)


def _source_key(source: Column) -> Column:
    """Names that sort as sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def n_words(text: Column) -> Column:
    """How many runs of characters other than blank, tab and line ends a text has; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _slots(docs: DataFrame, plan: Plan, block: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, rank, pass, block, words): what fills every slot of every shard."""
    spark = docs.sparkSession
    total = int(plan.slots.sum())
    shards = -(-total // shard)
    chances = plan.slots / max(total, 1)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                n = min(shard, total - i * shard)
                counts = np.random.default_rng([seed, i]).multinomial(n, chances)
                rank = np.flatnonzero(counts)
                counts = counts[rank]
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(rank), i), "rank": rank, "n": counts, "at": np.cumsum(counts) - counts})

    draws = written(spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(
        drawn, "shard bigint, rank bigint, n bigint, at bigint"), "draws")
    got = np.zeros(len(plan.slots), np.int64)
    for rank, n in draws.groupBy("rank").agg(F.sum("n")).collect():  # one row a source
        got[rank] = n
    # Draws come out near the slots wanted, not at them: what a source drew too many goes to those that drew too few.
    spare, lack = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    spare_from, lack_to = np.cumsum(spare) - spare, np.cumsum(lack)
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = draws.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("shard", "rank", "n", "at", "first")}
                j, rank = np.arange(one["first"], one["first"] + one["n"]), np.full(one["n"], one["rank"])
                over = j >= plan.slots[one["rank"]]
                if over.any():
                    q = spare_from[one["rank"]] + j[over] - plan.slots[one["rank"]]
                    to = np.searchsorted(lack_to, q, "right")
                    rank[over], j[over] = to, got[to] + q - (lack_to[to] - lack[to])
                blocks = plan.blocks[rank]
                turn, place = j // blocks, j % blocks
                index = permuted(place, blocks, _key(seed, rank, turn))
                words = np.where(index == blocks - 1, plan.words[rank] - (blocks - 1) * block, block)
                words = np.where(j == plan.slots[rank] - 1, np.minimum(words, plan.cut[rank]), words)
                size = np.full(one["n"], min(shard, total - one["shard"] * shard))
                slot = permuted(np.arange(one["at"], one["at"] + one["n"]), size, _key(seed + 1, np.full(one["n"], one["shard"])))
                yield pa.RecordBatch.from_pydict({"shard": np.full(one["n"], one["shard"]), "slot": slot, "rank": rank, "turn": turn, "block": index, "words": words})

    return numbered.mapInArrow(filled, "shard bigint, slot bigint, rank bigint, turn bigint, block bigint, words bigint")


@dataclass(frozen=True)
class Mix:
    """``docs`` (doc_id, source, size, source_size, target, idx, rank), ``slots`` and ``pieces`` (rank, idx, block, start, words, at).

    A piece is a run of a document's words in a block: from word ``start`` of the document, at word ``at`` of the block.
    """

    docs: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weigh=lambda i: i % 3 + 1, block: int = BLOCK, shard: int = SLOTS, seed: int = 0) -> Mix:
    """Draw a mix of ``docs`` (doc_id, source, text) as large as all its words, sources by weight.

    ``weigh`` gives the weight of the i-th source by code point, null last (from 0).  A source is taken at most three
    times; what it cannot give is shared again.  Every source gives its target's whole words exactly, and no document is
    taken more often than three times.  The same rows in the same ids give the same mix again.  Null and empty texts have
    no words and are never taken; repeated rows are documents each; documents of equal or null id lie in the order of a
    hash of their text; other columns are ignored; an empty table gives an empty mix.

    Documents get their place in their source's words by ranges of doc_id, so a source of any size is spread; blocks and
    slots meet by (source, block), which has at most four slots.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", _source_key(F.col("source")).alias("_group"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    placed, groups = ranked(rows, "_group", ["doc_id", "hash"], size="size")
    found = groups.orderBy("_group").limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    words = np.array([r["total"] for r in found], np.int64)
    plan = planned([r["_group"] for r in found], words, np.array([weigh(i) for i in range(len(found))], float), block, seed)
    named = spark.createDataFrame(list(zip(plan.sources, range(len(found)), words.tolist(), plan.targets.tolist())),
                                  "_group string, rank bigint, source_size bigint, target double")
    placed = written(placed.join(named, "_group").select("doc_id", "source", "size", "source_size", "target", "idx", "rank", "before"), "placed")
    spans = placed.where("size > 0").select("rank", "idx", "before", "size", F.explode(F.sequence(
        F.expr(f"before div {block}"), F.expr(f"(before + size - 1) div {block}"))).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("before"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("before"), F.col("size"))
    pieces = spans.select("rank", "idx", "block", start.alias("start"), (end - start).alias("words"),
                          (F.col("before") + start - F.col("block") * block).alias("at"))
    return Mix(placed.drop("before"), written(_slots(docs, plan, block, shard, seed), "slots"), pieces)


def drawn(made: Mix) -> DataFrame:
    """The mix itself: (shard, slot, at, rank, idx, start, words), what each slot holds of which document, in order of ``at``."""
    slots = made.slots.select("shard", "slot", "rank", "block", F.col("words").alias("_slot_words"))
    # Files of places and slots are a small part of their rows, so their size says nothing about whether the driver can hold them.
    each = made.pieces.join(slots.hint("merge"), ["rank", "block"]).withColumn("words", F.least("words", F.col("_slot_words") - F.col("at")))
    return each.where("words > 0").select("shard", "slot", "at", "rank", "idx", "start", "words")


def taken(made: Mix) -> DataFrame:
    """Every document with the number of its words in the mix."""
    used = drawn(made).groupBy("rank", "idx").agg(F.sum("words").alias("taken"))
    return made.docs.join(used.hint("merge"), ["rank", "idx"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
