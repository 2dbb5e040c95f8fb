"""The whole way of a page: detect, settle, filter, mask, all inside the row that holds its text."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, functions as F

from tachado import constants as K
from tachado.functions.text import is_blank
from tachado.operators.aggregate import engine_text
from tachado.operators.detect import numbered, page_candidates, user_candidates
from tachado.operators.mask import active_array, ignore_array, mask_array
from tachado.operators.model import model_candidates
from tachado.operators.overlap import explode_entities, resolve_array
from tachado.schemas import CANDIDATES


def detect_pages(pages: DataFrame, rules: Iterable | DataFrame | None = None, engine: str = "jvm") -> DataFrame:
    """``pages`` with an ``entities`` array: settled candidates of rules and model.

    ``pages`` has doc_id, page, text, and optionally
    ``response`` (the model's answer), ``method`` (which engines count),
    ``ignored`` (array of values to leave alone), ``active_types`` (map<type, boolean>).
    ``rules`` is one list for all, or a frame of rules per ``user_id``.
    No stage shuffles, except the join that brings rules per user.
    """
    kept = pages.columns
    none = F.array().cast(CANDIDATES)
    method = F.coalesce("method", F.lit(K.DEFAULT_METHOD)) if "method" in kept else F.lit(K.DEFAULT_METHOD)
    by_rule = user_candidates(pages, rules) if isinstance(rules, DataFrame) else page_candidates(pages, rules, engine=engine)
    wanted = F.when(method.isin("regex", "both") & ~is_blank("text"), F.col("candidates")).otherwise(none)
    out = by_rule.withColumn("_rules", wanted).drop("candidates")
    if "response" in kept:
        asked = F.when(method.isin("ai", "both"), F.col("response"))
        out = model_candidates(out.withColumn("response", asked)).withColumn("_all", F.concat("candidates", "_rules"))
        out = out.drop("candidates").withColumn("_all", F.when(F.size("_all") > 0, numbered(F.col("_all"))).otherwise(none))
    else:
        out = out.withColumnRenamed("_rules", "_all")
    entities = F.when(F.size("_all") > 0, resolve_array("_all")).otherwise(none)
    out = out.withColumn("entities", entities)
    if "ignored" in kept:
        out = out.withColumn("entities", F.when(F.size("entities") > 0, ignore_array("entities", "ignored")).otherwise(none))
    if "active_types" in kept:
        out = out.withColumn("entities", F.when(F.size("entities") > 0, active_array("entities", "active_types")).otherwise(none))
    return out.select(*kept, "entities")


def mask_pages(pages: DataFrame, rules: Iterable | DataFrame | None = None, labels: dict | None = None,
               engine: str = "jvm") -> DataFrame:
    """``pages`` with ``entities`` and ``masked_text``."""
    found = detect_pages(pages, rules, engine)
    return found.withColumn("masked_text", mask_array("text", "entities", labels, settled=True))


def entities_of(found: DataFrame) -> DataFrame:
    """Entity rows of detected pages."""
    return explode_entities(found, "entities")


def document_summary(found: DataFrame, model_id: str = K.DEFAULT_MODEL_ID, keys=("doc_id",)) -> DataFrame:
    """Per document: pages, entities by source and in all, and the engine label; combined map-side."""
    def of(source):
        return F.size(F.filter("entities", lambda e: e["source"] == source))
    rows = found.select(*keys, F.size("entities").alias("n"), of(K.SOURCE_MODEL).alias("m"), of(K.SOURCE_RULES).alias("r"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("entities_found"),
        F.sum("m").alias("from_model"), F.sum("r").alias("from_rules"))
    return sums.withColumn("engine", engine_text(F.col("from_model") > 0, F.col("from_rules") > 0, F.lit(model_id)))


def completion_events(docs: DataFrame, summary: DataFrame, ts) -> DataFrame:
    """A COMPLETED status update for every document, with nothing found as well as with something."""
    joined = docs.select("user_id", "doc_id", "file_name").join(summary, "doc_id", "left")
    return joined.select(
        "user_id", F.col("doc_id").cast("string").alias("document_id"), ts.alias("ts"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("update").alias("op"), F.lit("COMPLETED").alias("status"),
        F.coalesce("entities_found", F.lit(0)).alias("entities_found"), F.col("engine"), ts.alias("completed_at"))
