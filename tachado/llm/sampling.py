"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words with their counts.  For each of a number of samples every word draws, from a hash of itself and
the sample's number alone, two gamma variates and one uniform; with its weight they give a level and a rank, and the word
of least rank, with its level, is the document's sample.  Two documents agree on a sample with a probability equal to
their generalised Jaccard similarity: the sum of the smaller weights over the sum of the larger ones.

Nothing but the texts themselves is shuffled: they are dealt in ranges of document ids, and everything after stays in
its range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tachado.llm.tables import written

SAMPLES, AT_ONCE = 64, 4
#: Characters of text in a range, about.
RANGE_CHARS = 2_000_000
#: Of a sample's 64 bits the upper half orders by rank and the lower half names word and level.
RANK_SCALE, LOW = float(1 << 25), (1 << 32) - 1
SPAN = 1 << 53


def _uniform(bits: Column, skip: int, width: int) -> Column:
    """``width`` bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, skip).bitwiseAND((1 << width) - 1) + 0.5) / float(1 << width)


def drawn(word: Column, sample: Column, log_weight: Column) -> Column:
    """A word's draw for a sample: its rank above, what names word and level below; null for no weight.

    With r and c from gamma(2, 1) and b uniform, the level is t = floor(log weight / r + b) and the rank's logarithm
    log c - r (t - b + 1).
    """
    one, two = F.xxhash64(word, sample, F.lit(5)), F.xxhash64(word, sample, F.lit(9))
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    c = -F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32))
    b = _uniform(one, 42, 21)
    level = F.floor(log_weight / r + b)
    rank = F.floor((F.log(c) - r * (level - b + 1)) * RANK_SCALE)
    return F.shiftleft(rank, 32).bitwiseOR(F.xxhash64(word, level).bitwiseAND(LOW))


def ranged(docs: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """``docs`` (doc_id, text) dealt by ranges of doc_id that end at an id that exists: with bucket, ghost and tie.

    The document of the highest id of a range is there once more, as a ghost in the next range up, and that of the
    highest id of all in the lowest range: so each range holds, for every document, the next one in descending order.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    s = rows.agg(F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = s["low"] or 0, s["high"] or 0
    if high - low >= SPAN:
        raise ValueError("document ids must span less than 2**53")
    n = max(1, -(-(s["chars"] or 0) // size))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or [])) if n > 1 else []
    cuts = [c for c in cuts if c < high]

    def dealt(df: DataFrame, id_: Column) -> DataFrame:
        if not cuts:
            return df.withColumn("bucket", F.lit(0))
        splits = [-float("inf"), *(float(low - c) for c in reversed(cuts)), float("inf")]
        place = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(
            df.withColumn("_at", (F.lit(low) - F.coalesce(id_, F.lit(low))).cast("double")))
        # Never null, so that a join on it adds no filter to one of two equal branches, which then share their shuffle.
        return place.withColumn("bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(0))).drop("_at", "_bucket")

    # Ranges count from the highest ids; a range's highest id is a cut, and the id after it lies in the range above.
    real = dealt(rows, F.col("doc_id")).withColumn("ghost", F.lit(False))
    above = dealt(dealt(rows, F.col("doc_id")).withColumnRenamed("bucket", "_own"), F.col("doc_id") + 1)
    last = F.lit(len(cuts))
    ghosts = above.where((F.col("bucket") != F.col("_own")) & (F.col("doc_id") != high) | (F.col("doc_id") == high)).withColumn(
        "bucket", F.when(F.col("doc_id") == high, last).otherwise(F.col("bucket"))).withColumn("ghost", F.lit(True)).drop("_own")
    return real.unionByName(ghosts).withColumn("tie", F.xxhash64("text"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``ranged`` documents: bucket, place, ghost, doc_id, text and edited.

    ``edited`` has the last third of the code points (rounded down) replaced by the first as many, or all, of the next
    document's; the order is descending doc_id, null last, equal ids by a hash of the text, and the last one's next is
    the first.
    """
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("doc_id"), F.desc("tie"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    placed = docs.repartition("bucket").select(
        "bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("_next"))
    return placed.select("bucket", "place", "ghost", "doc_id", "text", F.concat(
        F.substr("text", F.lit(1), n - third), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), third)).alias("edited"))


def samples(rows: DataFrame, texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """Samples of the named texts of each row (bucket, place, ...): bucket, place and an array of bigint for each text.

    A text without words has no row of its own; one beside others has null samples.
    """
    each = rows.select("bucket", "place", F.posexplode(F.array(*texts)).alias("side", "text"))
    words = each.select("bucket", "place", "side", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where(F.col("word") != "")
    counts = words.groupBy("bucket", "place", F.xxhash64("word").alias("word")).agg(
        *(F.count(F.when(F.col("side") == i, 1)).alias(f"n{i}") for i in range(len(texts))))
    logs = counts.select("bucket", "place", "word", *(F.when(F.col(f"n{i}") > 0, F.log(f"n{i}")).alias(f"log{i}") for i in range(len(texts))))
    groups = logs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // AT_ONCE - 1))).alias("g"))
    least = groups.groupBy("bucket", "place", "g").agg(*(
        F.min(drawn(F.col("word"), F.col("g") * AT_ONCE + k, F.col(f"log{i}"))).alias(f"s{i}_{k}") for i in range(len(texts)) for k in range(AT_ONCE)))
    parts = F.struct("g", *(F.array(*(F.col(f"s{i}_{k}").bitwiseAND(LOW) for k in range(AT_ONCE))).alias(text) for i, text in enumerate(texts)))
    whole = least.groupBy("bucket", "place").agg(F.array_sort(F.collect_list(parts)).alias("p"))
    return whole.select("bucket", "place", *(F.flatten(F.transform("p", lambda p: p[text])).alias(text) for text in texts))


def written_out(samples: Column) -> Column:
    """Samples as text, eight hexadecimal digits each; empty for a text without words."""
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints; two empty ones are alike, an empty and another one are not."""
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.size(a))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and how alike they and the next one's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty;
    repeated rows stay; other columns are ignored; equal texts have equal fingerprints; an empty table gives no rows.
    """
    rows = with_edits(ranged(docs))
    info = rows.select("bucket", "place", "ghost", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"))
    empty = F.array().cast("array<bigint>")
    known = F.filter(F.coalesce("text", empty), lambda s: s.isNotNull())
    known_edited = F.filter(F.coalesce("edited", empty), lambda s: s.isNotNull())
    both = written(info.join(samples(rows, ["text", "edited"]), ["bucket", "place"], "left").select(
        *info.columns, known.alias("own"), known_edited.alias("edited")), "fingerprints")
    following = both.withColumn("following", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("ghost"))
    own, edited, following_ = F.col("own"), F.col("edited"), F.col("following")
    return following.select(
        "doc_id", "n_chars", "edited_sha256", written_out(own).alias("fingerprint"), written_out(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following_).alias("near_next"))
