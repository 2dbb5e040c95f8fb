"""Finding entity texts again in words and pages.

The text of an entity may differ from the page in accents, blanks, dashes or line
breaks; ``functions/spelling`` says how it is found all the same.  Whatever is
looked for on a page travels to it as one list, and the page is walked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tachado.functions.spelling import on_page, page_places, page_runs, page_stretches
from tachado.functions.text import quote
from tachado.operators.mask import mask_array
from tachado.operators.overlap import candidate_array
from tachado.schemas import CANDIDATE, CANDIDATES
from tachado.session import stored

_KEYS = ["doc_id", "page"]
#: Texts that one walk over a page looks for; a document with more has its pages walked once per so many.
NEEDLES = 1000


def locate_tolerant(entities: DataFrame, words: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Runs of words that spell each entity on its page.

    One row per occurrence: the entity's columns, ``occurrence`` and the run as
    ``first_word``/``last_word`` (word_ord), with ``run`` holding the words from
    first to last and their ``fields``.
    """
    fields = fields or []
    # Only the words of pages that have a target are brought together.
    row = F.struct("word_ord", "text", *fields)
    pages = words.join(entities.select(*_KEYS).distinct(), _KEYS, "left_semi").groupBy(*_KEYS).agg(
        F.array_sort(F.collect_list(row)).alias("_words"))
    return locate_in_pages(entities, pages, F.transform("_words", lambda w: w["text"]), lambda w, at: F.get("_words", at))


def locate_in_pages(entities: DataFrame, pages: DataFrame, words: Column, laid: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """As ``locate_tolerant``, with the words of each page in order as an array of texts, stated by the page's row.

    ``laid`` gives a word of a run as a struct, from its text and place; word_ord and text if None.  A page and its targets
    meet by one shuffle, words are cut after it, and only those that are found become rows.
    """
    laid = laid or (lambda w, at: F.struct(at.alias("word_ord"), w.alias("text")))
    rest = [c for c in entities.columns if c not in _KEYS]
    mine = entities.groupBy(*_KEYS).agg(F.collect_list(F.struct(*rest)).alias("_e"))
    met = pages.join(mine, _KEYS).withColumn("_w", words)
    found = met.withColumn("_runs", page_runs("_w", F.transform("_e", lambda e: e["text"])))

    def hit(r):
        run = F.slice("_w", r["first"] + 1, r["last"] - r["first"] + 1)
        return F.struct(F.get("_e", r["target"]).alias("of"), r["occurrence"].alias("occurrence"),
                        F.transform(run, lambda w, i: laid(w, r["first"] + i)).alias("run"))

    # A hit takes what is its own along, not the page.
    hits = found.select(*_KEYS, F.explode(F.transform("_runs", hit)).alias("_r"))
    kept = [F.col(c) if c in _KEYS else F.col(f"_r.of.{c}").alias(c) for c in entities.columns]
    return hits.select(*kept, "_r.occurrence", F.get("_r.run", F.lit(0))["word_ord"].alias("first_word"),
                       F.element_at("_r.run", -1)["word_ord"].alias("last_word"), "_r.run")


def locate_any_page(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities with the first page of their document that has them (J12); those that are nowhere have no row.

    A page has an entity if its text contains it, or its words spell it.  A document's texts travel to its pages in
    lists of about a thousand, and a page is walked once per list by automata over them: only what is found leaves the row.
    """
    needles = entities.select("doc_id", "text").filter("text <> ''").distinct()
    sizes = needles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).select("doc_id", F.ceil(F.col("_n") / NEEDLES).alias("_lists"))
    dealt = needles.join(sizes, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("text"), F.col("_lists")).alias("_list")).agg(
        F.collect_list("text").alias("_needles"))
    met = pages.select("doc_id", "page", F.col("text").alias("_text")).join(dealt, "doc_id")
    hits = met.select("doc_id", "page", F.explode(on_page("_text", "_needles")).alias("text"))
    first = hits.groupBy("doc_id", "text").agg(F.min("page").alias("found_page"))
    return entities.join(first, ["doc_id", "text"])


def locate(entities: DataFrame, pages: DataFrame, words: DataFrame | Column, ocr_words: DataFrame | None = None) -> DataFrame:
    """How each entity is found: literally, tolerantly, on another page, in recognised words, or not.

    Each step only sees what the one before it left.  ``entities`` has doc_id, page,
    ord and text; ``words`` are rows, or the texts of the words of ``pages`` as their rows state them.  What is left after the
    literal step is stored once, since the later steps read it again and again.
    """
    ids = ["doc_id", "page", "ord"]
    mine = entities.filter(F.coalesce("text", F.lit("")) != "").select(*ids, "text")
    texts = pages.select("doc_id", "page", F.col("text").alias("page_text"))
    literal = stored(mine.join(texts, _KEYS, "left").select(
        *ids, "text", F.coalesce(F.contains("page_text", F.col("text")), F.lit(False)).alias("_exact")))
    left = literal.filter("not _exact").drop("_exact")
    spelled = locate_in_pages(left, pages, words) if isinstance(words, Column) else locate_tolerant(left, words)
    tolerant = stored(spelled.select(*ids).distinct().withColumn("_tolerant", F.lit(True)))
    left = left.join(tolerant, ids, "left_anti")
    moved = locate_any_page(left, pages).select(*ids, "found_page")
    out = literal.join(tolerant, ids, "left").join(moved, ids, "left")
    how = (F.when(F.col("_exact"), "exact").when(F.col("_tolerant"), "tolerant")
           .when(F.col("found_page").isNotNull(), "other_page"))
    if ocr_words is not None:
        moved = stored(moved)
        left = left.join(moved, ids, "left_anti")
        seen = locate_tolerant(left, ocr_words).select(*ids).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, ids, "left")
        how = how.when(F.col("_seen"), "ocr")
    how = how.otherwise("missing")
    at = F.when(how.isin("exact", "tolerant", "ocr"), F.col("page")).when(how == "other_page", F.col("found_page"))
    return out.select(*ids, how.alias("how"), at.alias("found_page"))


def relocate(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities with their page replaced by the first that has them, where their own does not.

    An entity that is nowhere keeps its page.
    """
    texts = pages.select("doc_id", "page", F.col("text").alias("page_text"))
    literal = F.coalesce(F.contains("page_text", F.col("text")), F.lit(False))
    seen = stored(entities.join(texts, _KEYS, "left").withColumn("_here", literal).drop("page_text"))
    away = seen.filter("not _here").drop("_here")
    # A page that spells it tolerantly counts as its own.
    tokens = F.array_remove(F.split("text", r"[\p{IsWhite_Space}\x1c-\x1f]+", -1), "")
    spelled = locate_in_pages(away, pages, tokens).select(*_KEYS, "text").distinct()
    lost = stored(away.join(spelled, [*_KEYS, "text"], "left_anti"))
    found = locate_any_page(lost, pages).select(*_KEYS, "text", "found_page").distinct()
    return seen.drop("_here").join(found, [*_KEYS, "text"], "left").withColumn(
        "page", F.coalesce("found_page", "page")).select(*entities.columns)


def mask_occurrences(pages: DataFrame, entities: DataFrame, as_written: bool = False) -> DataFrame:
    """Every occurrence of each entity's text on its page masked, with the count.

    Literal occurrences in any case, and wherever the words of the page spell it; a place that is taken stays taken.
    ``as_written``: the text exactly as it stands, and occurrences that overlap are masked as one place.
    ``occurrences_masked`` counts places, not entities.  Entities that may be on
    another page go through ``relocate`` first.
    """
    none = F.array().cast(CANDIDATES)
    texts = entities.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(candidate_array())).alias("_e"))
    mine = pages.join(texts, _KEYS, "left").withColumn("_e", F.coalesce("_e", none))
    t = F.col("text")

    def gaps(e):
        """Lengths of the text before, between, but not after the occurrences of an entity's text."""
        case = (lambda x: x) if as_written else F.lower
        pieces = F.split(t, quote(e["text"]) if as_written else F.concat(F.lit("(?iu)"), quote(e["text"])), -1)
        between = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
        return F.when((F.coalesce(e["text"], F.lit("")) != "") & F.contains(case(t), case(e["text"])), between)

    some = F.size("_e") > 0
    targets, between = F.transform("_e", lambda e: e["text"]), F.when(some, F.transform("_e", gaps))
    mine = mine.withColumn("_at", page_stretches(targets, between) if as_written else page_places(F.when(some, t), targets, between))

    def candidate(p, i):
        e = F.get("_e", p["target"])
        said = F.when(p["loose"] == 1, e["text"]).otherwise(F.substr(t, p["start"] + 1, p["end"] - p["start"]))
        return F.struct(i, e["type"], p["start"], p["end"], said, e["source"], e["confidence"]).cast(CANDIDATE)

    mine = mine.withColumn("occurrences", F.transform("_at", candidate))
    # Places do not overlap and lie inside the text; from left to right they are masked in one walk.
    across = F.transform(F.array_sort(F.transform("occurrences", lambda c: F.struct(c["start_offset"].alias("s"), c.alias("c")))), lambda x: x["c"])
    mine = mine.withColumn("_across", across)
    return mine.withColumn("masked_text", mask_array("text", "_across", settled=True)).withColumn(
        "occurrences_masked", F.size("occurrences")).drop("_e", "_at", "_across")
