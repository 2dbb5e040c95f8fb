"""Labels, masked text, reports and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tachado import constants as K
from tachado.functions.display import lookup
from tachado.functions.reuse import once_per_session
from tachado.functions.text import as_col, fold
from tachado.operators.overlap import candidate_array

_CHUNK = 64


def label(entity_type, source, labels: dict | None = None) -> Column:
    """``[TYPE-SUFFIX]``, or ``[TYPE]`` for a source without a suffix; no type reads ``PII``."""
    kind = F.coalesce(F.nullif(as_col(entity_type), F.lit("")), F.lit("PII"))
    suffix = lookup(source, labels or K.SOURCE_SUFFIX, F.lit(None).cast("string"))
    return F.concat(F.lit("["), F.concat_ws("-", kind, suffix), F.lit("]"))


def highlight(entity_type, colours: dict | None = None) -> Column:
    """Colour of a type as struct<r,g,b>, with a default."""
    def rgb(c):
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("rgb", c)])
    out = F
    for kind, colour in (colours or K.HIGHLIGHTS).items():
        out = out.when(as_col(entity_type) == kind, rgb(colour))
    return out.otherwise(rgb(K.DEFAULT_HIGHLIGHT))


def _spliced(text: Column, ents: Column, labels) -> Column:
    """Gaps and labels from left to right, for valid spans in order that do not overlap.

    Counting to a code point means walking the text, so entities go in runs of
    64 and each run only walks its own stretch.
    """
    n = F.size(ents)
    starts = F.sequence(F.lit(0), n - 1, F.lit(_CHUNK))

    def end_before(i):
        return F.when(i == 0, F.lit(0)).otherwise(F.get(ents, i - 1)["end_offset"])

    def run(first):
        last = F.least(first + _CHUNK, n) - 1
        begin = end_before(first)
        stretch = F.substr(text, begin + 1, F.get(ents, last)["end_offset"] - begin)
        return F.struct(first.alias("first"), last.alias("last"), begin.alias("begin"), stretch.alias("t"))

    def written(r):
        return F.transform(F.sequence(r["first"], r["last"]), lambda i: F.concat(
            F.substr(r["t"], end_before(i) - r["begin"] + 1, F.get(ents, i)["start_offset"] - end_before(i)),
            label(F.get(ents, i)["type"], F.get(ents, i)["source"], labels)))

    head = F.array_join(F.flatten(F.transform(F.transform(starts, run), written)), "")
    return F.concat(head, F.substr(text, F.get(ents, n - 1)["end_offset"] + 1))


def _folded(text: Column, ents: Column, labels) -> Column:
    """Right to left, one at a time; a span outside the text replaces its first literal occurrence."""
    backwards = F.array_sort(F.transform(ents, lambda e, i: F.struct(
        (-e["start_offset"]).alias("s"), i.alias("i"), e.alias("e"))))

    def step(t, x):
        e = x["e"]
        s, n, what = e["start_offset"], e["end_offset"], e["text"]
        name = label(e["type"], e["source"], labels)
        invalid = (s < 0) | (n <= s) | (n > F.length(t))
        at = F.when(F.coalesce(what, F.lit("")) == "", 0).otherwise(F.instr(t, what))
        return (F.when(~invalid, F.concat(F.substr(t, F.lit(1), s), name, F.substr(t, n + 1)))
                .when(at > 0, F.concat(F.substr(t, F.lit(1), at - 1), name, F.substr(t, at + F.length(what))))
                .otherwise(t))

    return F.aggregate(backwards, text, step)


@once_per_session
def mask_array(text, entities, labels: dict | None = None, settled: bool = False) -> Column:
    """Page text with its entity array replaced by labels (R2).

    ``settled`` says the entities come straight from ``resolve_array``: in order,
    inside the text, not overlapping.
    """
    t, ents = as_col(text), as_col(entities)
    nothing = ents.isNull() | (F.size(ents) == 0)
    if settled:
        return F.when(nothing, t).otherwise(_spliced(t, ents, labels))
    ordered = F.transform(F.array_sort(F.transform(ents, lambda e, i: F.struct(
        e["start_offset"].alias("s"), i.alias("i"), e.alias("e")))), lambda x: x["e"])

    def applied(o):
        clean = F.aggregate(o, F.lit(0), lambda reach, e: F.when(
            (reach < 0) | (e["start_offset"] < reach) | (e["end_offset"] <= e["start_offset"]) | (e["end_offset"] > F.length(t)),
            F.lit(-1)).otherwise(e["end_offset"])) >= 0
        return F.when(clean, _spliced(t, o, labels)).otherwise(_folded(t, ents, labels))

    # Bound as the one element of an array, so that it is sorted once and not wherever it is referred to.
    return F.when(nothing, t).otherwise(F.get(F.transform(F.array(ordered), applied), F.lit(0)))


def entities_by_page(pages: DataFrame, entities: DataFrame, keys=("doc_id", "page")) -> DataFrame:
    """``pages`` with the array of their own entities; pages without any are kept.

    What is collected is one page's entities, bounded by the page's text.
    """
    grouped = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(candidate_array())).alias("entities"))
    return pages.join(grouped, list(keys), "left")


def mask_text(pages: DataFrame, entities: DataFrame, labels: dict | None = None) -> DataFrame:
    """``pages`` with ``masked_text`` and the entities applied to each (R2)."""
    return (entities_by_page(pages, entities)
            .withColumn("masked_text", mask_array("text", "entities", labels))
            .withColumn("n_entities", F.coalesce(F.size("entities"), F.lit(0))).drop("entities"))


def page_report(masked_pages: DataFrame, file_name="file_name") -> DataFrame:
    """The report of each document as ordered sections: a header, then one per page.

    ``masked_pages`` has doc_id, page, masked_text and the file name.  A section is
    a row, so a document of any length is written by many tasks; joined by line
    feeds in (doc_id, section) order the rows are the report file.
    """
    name = as_col(file_name)
    header = F.concat_ws("\n", F.concat(F.lit(K.REPORT_TITLE), F.col("f")), F.lit(""),
                         F.concat(F.lit(K.REPORT_FILE), F.col("f")), F.lit(""), F.lit(K.REPORT_RULE), F.lit(""))
    heads = masked_pages.groupBy("doc_id").agg(F.min(name).alias("f")).select(
        "doc_id", F.lit(0).alias("section"), header.alias("body"))
    bodies = masked_pages.select("doc_id", F.col("page").cast("int").alias("section"), F.concat_ws(
        "\n", F.concat(F.lit(K.REPORT_PAGE), F.col("page").cast("string")), F.lit(""),
        F.col("masked_text"), F.lit("")).alias("body"))
    return heads.unionByName(bodies)


def output_name(file_name, kind: str) -> Column:
    """``a/b.c.pdf`` -> ``b.c_ofuscado.pdf`` or ``b.c_informe.md``."""
    endings = {"pdf": "_ofuscado.pdf", "text": "_ofuscado.txt", "markdown": "_informe.md"}
    if kind not in endings:
        raise ValueError(f"unknown output kind: {kind}")
    base = F.regexp_extract(F.regexp_replace(as_col(file_name), r"/+\z", ""), r"[^/]*\z", 0)
    # A dot at the very start or very end of the name does not begin an extension.
    stem = F.regexp_replace(base, r"(?<=[^/])(?<!\A\.)\.[^./]+\z", "")
    return F.concat(stem, F.lit(endings[kind]))


def maskable(docs: DataFrame, entities: DataFrame, toggles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents to mask, documents with nothing left to mask and a finished status row)."""
    kept = entities if toggles is None else keep_active_types(entities, toggles)
    ids = kept.select("doc_id").distinct()
    to_mask = docs.join(ids, "doc_id", "left_semi")
    nothing = docs.join(ids, "doc_id", "left_anti").select(
        "*", F.lit("COMPLETED").alias("status"), F.lit(0).alias("entities_found"))
    return to_mask, nothing


def drop_ignored(entities: DataFrame, ignored: DataFrame) -> DataFrame:
    """Entities whose folded text is not on their user's list; blank list values do nothing.

    ``entities`` has user_id and text, ``ignored`` has user_id and value.
    """
    listed = ignored.select("user_id", fold("value").alias("_folded")).filter("_folded <> ''").distinct()
    return (entities.withColumn("_folded", fold("text")).join(listed, ["user_id", "_folded"], "left_anti")
            .select(*entities.columns))


def ignore_array(entities, ignored) -> Column:
    """Array form of ``drop_ignored``: one page's entities against its user's list."""
    values = F.transform(F.coalesce(as_col(ignored), F.array().cast("array<string>")), fold)
    return F.filter(as_col(entities), lambda e: ~F.array_contains(values, fold(e["text"])))


def keep_active_types(entities: DataFrame, toggles: DataFrame) -> DataFrame:
    """Entities whose type is on for their user; types without a switch always stay.

    ``toggles`` has user_id, type and active, at most one row per user and type.
    """
    switched = toggles.filter(F.col("type").isin(list(K.SWITCHED_TYPES.values()))).select("user_id", "type", "active")
    return (entities.join(switched, ["user_id", "type"], "left")
            .filter(F.coalesce("active", F.lit(True))).select(*entities.columns))


def active_array(entities, active_types) -> Column:
    """Array form of ``keep_active_types``: ``active_types`` is map<type, boolean>."""
    switched = list(K.SWITCHED_TYPES.values())
    return F.filter(as_col(entities), lambda e: ~e["type"].isin(switched)
                    | F.coalesce(F.try_element_at(as_col(active_types), e["type"]), F.lit(True)))


def redaction_counts(occurrences: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Masked occurrences per document and type, as rows."""
    return occurrences.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def with_totals(counts: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Each count with its document's ``total`` and number of ``types``; a document has one row per type."""
    w = Window.partitionBy(*keys)
    return counts.withColumns({"total": F.sum("n").over(w), "types": F.count(F.lit(1)).over(w).cast("int")})


def counts_by_type(counts: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Total and map<type, n> per document; a document has one row per type, so the map is small."""
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
