"""Settling overlapping candidates.

Which candidates survive depends on their order, so this is a fold, not a set
expression.  It runs on the candidate array of one page, inside the row: no
shuffle, and legal on streams.  Candidates are first cut into islands that touch
nobody else's span, so the quadratic part is only ever as long as a pile-up.
A page is the unit because its text is one cell already; documents are never
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tachado import constants as K
from tachado.functions.reuse import once_per_session
from tachado.functions.text import as_col
from tachado.schemas import CANDIDATE, CANDIDATE_FIELDS, CANDIDATES
from tachado.session import stored


def overlap_ratio(start_a, end_a, start_b, end_b) -> Column:
    """Shared characters over the length of the shorter span; 0 for an empty span."""
    sa, ea, sb, eb = map(as_col, (start_a, end_a, start_b, end_b))
    shared = F.greatest(F.lit(0), F.least(ea, eb) - F.greatest(sa, sb))
    shorter = F.least(ea - sa, eb - sb)
    return F.when(shorter == 0, F.lit(0.0)).otherwise(shared.cast("double") / F.nullif(shorter, F.lit(0)))


def _overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start_offset"], b["start_offset"]) < F.least(a["end_offset"], b["end_offset"])


def _priority(source: Column, priority: dict) -> Column:
    out = F
    for name, rank in priority.items():
        out = out.when(source == name, rank)
    return out.otherwise(0)


def _stronger(priority: dict):
    """Does ``b`` (later) beat ``a`` (earlier): span, then confidence, then source."""
    def beats(b: Column, a: Column) -> Column:
        def rank(x):
            return F.struct(x["end_offset"] - x["start_offset"], x["confidence"], _priority(x["source"], priority))
        return rank(b) > rank(a)
    return beats


def _longer_or_surer(b: Column, a: Column) -> Column:
    def rank(x):
        return F.struct(x["end_offset"] - x["start_offset"], x["confidence"])
    return rank(b) > rank(a)


def _same_type_above(threshold: float):
    def clash(a: Column, b: Column) -> Column:
        ratio = overlap_ratio(a["start_offset"], a["end_offset"], b["start_offset"], b["end_offset"])
        return (a["type"] == b["type"]) & (ratio > threshold)
    return clash


def _islands(cands: Column) -> Column:
    """Candidates by position, cut where a span starts at or after every earlier end."""
    by_start = F.array_sort(F.transform(cands, lambda c: F.struct(
        c["start_offset"].alias("s"), c["ord"].alias("o"), c.alias("c"))))
    empty = F.array().cast(f"array<{CANDIDATES}>")
    state = F.struct(F.lit(-1).alias("reach"), empty.alias("done"), F.array().cast(CANDIDATES).alias("open"))

    def step(acc, x):
        c = x["c"]
        apart = (c["start_offset"] >= acc["reach"]) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.greatest(acc["reach"], c["end_offset"]).alias("reach"),
            F.when(apart, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(apart, F.array(c)).otherwise(F.concat(acc["open"], F.array(c))).alias("open"))

    return F.aggregate(by_start, state, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def _fold(island: Column, clash, beats) -> Column:
    """Walk the candidates in order; a living one drops those it clashes with until one beats it."""
    ordered = F.array_sort(island)        # ``ord`` is the first field

    def survivors(xs: Column) -> Column:
        last = F.size(xs) - 1

        def step(alive, i):
            later = F.when(i < last, F.sequence(i + 1, last)).otherwise(F.array().cast("array<int>"))
            met = F.filter(later, lambda j: F.get(alive, j) & clash(F.get(xs, i), F.get(xs, j)))
            conqueror = F.get(F.filter(met, lambda j: beats(F.get(xs, j), F.get(xs, i))), F.lit(0))
            found = F.array(F.struct(met.alias("met"), conqueror.alias("j")))
            after = F.transform(found, lambda f: F.transform(alive, lambda a, k: a & ~(
                ((k == i) & f["j"].isNotNull())
                | (F.array_contains(f["met"], k) & F.coalesce(k < f["j"], F.lit(True))))))
            return F.when(F.get(alive, i), F.get(after, F.lit(0))).otherwise(alive)

        alive = F.aggregate(F.sequence(F.lit(0), last), F.transform(xs, lambda x: F.lit(True)), step)
        kept = F.filter(F.arrays_zip(xs.alias("x"), alive.alias("alive")), lambda z: z["alive"])
        return F.transform(kept, lambda z: z["x"])

    return F.when(F.size(ordered) < 2, ordered).otherwise(
        F.flatten(F.transform(F.array(ordered), survivors)))


def _settle(cands: Column, clash, beats) -> Column:
    settled = F.flatten(F.transform(_islands(cands), lambda isl: _fold(isl, clash, beats)))
    by_start = F.array_sort(F.transform(settled, lambda c: F.struct(
        c["start_offset"].alias("s"), c["ord"].alias("o"), c.alias("c"))))
    return F.when(F.size(cands) < 2, cands).otherwise(F.transform(by_start, lambda x: x["c"]))


@once_per_session
def resolve_array(candidates, priority: dict | None = None) -> Column:
    """Survivors of one page's candidate array, in reading order."""
    return _settle(as_col(candidates), _overlaps, _stronger(priority or K.SOURCE_PRIORITY))


@once_per_session
def dedup_array(candidates, threshold: float = 0.80) -> Column:
    """Same-type duplicates of one page removed: keep the longer, then the surer, then the earlier."""
    return _settle(as_col(candidates), _same_type_above(threshold), _longer_or_surer)


def candidate_array(*fields) -> Column:
    """A candidate struct in the shared shape; defaults to columns of the same names."""
    cols = fields or [F.col(f) for f in CANDIDATE_FIELDS]
    return F.struct(*[c.alias(f) for c, f in zip(cols, CANDIDATE_FIELDS)]).cast(CANDIDATE)


def _per_page(entities: DataFrame, settle, keys) -> DataFrame:
    """Fold each page that has more than one entity; the page is bounded by its own text."""
    pages = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(candidate_array())).alias("c"))
    return explode_entities(pages.select(*keys, settle("c").alias("c")), "c", keys)


def explode_entities(pages: DataFrame, column: str, keys=("doc_id", "page")) -> DataFrame:
    """One row per entity of the page arrays.

    The array is not exploded as a bare column: the optimizer would add a filter on
    its size and push it below the matching, which would then run twice.
    """
    present = F.filter(column, lambda e: e["ord"].isNotNull())
    return pages.select(*keys, F.explode(present).alias("_e")).select(
        *keys, *[F.col(f"_e.{f}").alias(f) for f in CANDIDATE_FIELDS])


def resolve_overlaps(entities: DataFrame, priority: dict | None = None, keys=("doc_id", "page")) -> DataFrame:
    """Entity rows without overlaps, each page settled across types."""
    return _per_page(entities, lambda c: resolve_array(c, priority), keys)


def dedup_same_type(entities: DataFrame, threshold: float = 0.80, keys=("doc_id", "page")) -> DataFrame:
    """Entity rows without same-type duplicates."""
    return _per_page(entities, lambda c: dedup_array(c, threshold), keys)


def candidate_order(entities: DataFrame, order_by, keys=("doc_id", "page")) -> DataFrame:
    """Number the candidates of each page: model answers first, then rules in rule and match order."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return entities.withColumn("ord", (F.row_number().over(w) - 1).cast("int"))


def in_reading_order(entities: DataFrame) -> DataFrame:
    """Global order by document, page and start, for a sink.

    A sort by range reads its input twice, first for the ranges, so the entities are stored before.
    """
    return stored(entities).orderBy("doc_id", "page", "start_offset", "ord")


def overlap_pairs(entities: DataFrame, keys=("doc_id", "page")) -> DataFrame:
    """Pairs of entities of a page that share characters, with their ratio.

    Pairs are found inside each island of touching spans, so nobody is compared
    with an entity elsewhere on the page.
    """
    pages = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(candidate_array())).alias("c"))
    islands = pages.filter(F.size("c") > 1).select(*keys, F.explode(_islands(F.col("c"))).alias("i"))
    pair = F.flatten(F.transform("i", lambda a: F.transform(
        F.filter("i", lambda b: (a["ord"] < b["ord"]) & _overlaps(a, b)),
        lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return (islands.filter(F.size("i") > 1).select(*keys, F.explode(pair).alias("p"))
            .select(*keys, F.col("p.a.ord").alias("ord_a"), F.col("p.b.ord").alias("ord_b"),
                    F.col("p.a.type").alias("type_a"), F.col("p.b.type").alias("type_b"),
                    overlap_ratio("p.a.start_offset", "p.a.end_offset",
                                  "p.b.start_offset", "p.b.end_offset").alias("ratio")))
