"""Counts over entities and the per-document entity file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tachado import constants as K
from tachado.functions.text import model_label

_COUNTED = [K.SOURCE_MODEL, K.SOURCE_RULES]


def source_contributions(entities: DataFrame) -> DataFrame:
    """Entities per document and known source, zeros included; other sources are not counted (A1)."""
    return entities.groupBy("doc_id").agg(*[F.count_if(F.col("source") == s).alias(s) for s in _COUNTED])


def entity_counts(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities per document, 0 for documents without any (A2)."""
    n = entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("entities_found"))


def engine_text(has_model: Column, has_rules: Column, model_id) -> Column:
    """``IA (model) + Regex`` from the engines that took part; none names the model (A3)."""
    model = F.concat(F.lit("IA ("), model_label(model_id), F.lit(")"))
    return F.concat_ws(" + ", F.when(has_model | ~has_rules, model), F.when(has_rules, F.lit("Regex")))


def engine_label(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Label of the engines that found each document's entities; ``docs`` has doc_id and model_id (A3)."""
    seen = entities.groupBy("doc_id").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in _COUNTED])

    def took_part(source):
        return F.coalesce(F.col(source), F.lit(False))

    return docs.select("doc_id", "model_id").join(seen, "doc_id", "left").select(
        "doc_id", engine_text(took_part(K.SOURCE_MODEL), took_part(K.SOURCE_RULES), "model_id").alias("engine"))


def entities_document(entities: DataFrame) -> DataFrame:
    """The entity file of each document in page-sized parts.

    One row per page that has entities: the page's array, with the document's
    totals beside it.  The array is bounded by a page; a document of any length is
    a set of rows, and ``sources.files.write_entities`` files them under it.
    """
    item = F.struct("start_offset", "ord", F.struct(
        "text", "type", "page", F.col("start_offset").alias("startOffset"), F.col("end_offset").alias("endOffset"),
        "source", "confidence").alias("e"))
    parts = entities.groupBy("doc_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("entities"))
    # From the parts, not from the entities again: both sides of the join then read one shuffle.
    def of(source):
        return F.size(F.filter("entities", lambda e: e["source"] == source))

    totals = parts.groupBy("doc_id").agg(
        F.sum(F.size("entities")).cast("int").alias("totalEntities"), *[F.sum(of(s)).cast("int").alias(s) for s in _COUNTED])
    return parts.join(totals, "doc_id").select(
        F.col("doc_id").alias("documentId"), "page", "totalEntities", "entities",
        F.create_map(*[x for s in _COUNTED for x in (F.lit(s), F.col(s))]).alias("sourceContributions"))
