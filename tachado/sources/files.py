"""Files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachado import constants as K
from tachado.operators.intake import header_reason, size_reason
from tachado.schemas import ENTITIES_DOCUMENT, ENTITIES_FIELDS, OCR, OCR_FIELDS


def fan_out(df: DataFrame, key: str, at_least: int | None = None) -> DataFrame:
    """Spread rows over the cores where a scan has fewer splits than there are cores.

    Matching is bound by CPU; a table that is one small file would run on one core.
    Large tables have more splits than cores and pass through without a shuffle.
    """
    cores = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str, *columns: str, spread: bool = False) -> DataFrame:
    """Some columns of a parquet table; ``spread`` by the first of them where the file is small."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return fan_out(df, df.columns[0]) if spread else df


def _listing(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def list_files(spark: SparkSession, root: str, glob: str | None = None, limit: int | None = None) -> DataFrame:
    """Files under a folder by name, size and time, the newest first, all of them or ``limit``; content is not read."""
    files = _listing(spark, root, glob).select(
        F.col("path").alias("key"), F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    ordered = files.orderBy(F.col("modified").desc(), "key")
    return ordered if limit is None else ordered.limit(limit)


def validate_folder(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Every file with the first check it fails.

    Size is a filter on metadata, pushed into the source, so the content of an
    oversized file is never read.
    """
    files = _listing(spark, root, glob)
    meta = ["path", "length", "modificationTime"]
    large = files.select(*meta).filter(F.col("length") >= max_bytes).withColumn("error_reason", size_reason("length", max_bytes))
    rest = files.filter(F.col("length") < max_bytes).select(*meta, header_reason("content").alias("error_reason"))
    return large.unionByName(rest)


def stream_files(spark: SparkSession, path: str, fmt: str = "binaryFile", schema=None, **options) -> DataFrame:
    """Files as they arrive."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


# ---------------------------------------------------------------- recognition results

def _write_json(rows: DataFrame, path: str, mode: str, by_document: bool) -> None:
    """JSON lines; a folder per document only on request, since a large corpus would drown in small files."""
    if by_document:
        rows.withColumn("document", F.col("documentId")).write.mode(mode).partitionBy("document").json(path)
    else:
        rows.write.mode(mode).json(path)


def write_ocr(pages: DataFrame, path: str, mode: str = "append", by_document: bool = False) -> None:
    """Recognition rows as JSON lines; keys without a value, such as error, are left out.

    ``pages`` has documentId and the fields of ``schemas.OCR`` that are known.  A row
    is a document or part of one: parts carry their pages, numbered.
    """
    _write_json(pages.select(*[f for f in OCR_FIELDS if f in pages.columns]), path, mode, by_document)


def read_ocr(spark: SparkSession, path: str, number_by_place: bool = False, multi_line: bool = False) -> DataFrame:
    """One row per page (doc_id, page, blocks) of stored recognition results.

    A page without a number is page 1, or its place in the list with ``number_by_place``.
    """
    docs = spark.read.schema(OCR).option("multiLine", multi_line).option("recursiveFileLookup", "true").json(path)
    pages = docs.select(F.col("documentId").alias("doc_id"), F.posexplode("pages").alias("pos", "p"))
    missing = (F.col("pos") + 1) if number_by_place else F.lit(1)
    return pages.select("doc_id", F.coalesce("p.pageNumber", missing).alias("page"), "pos", F.col("p.blocks").alias("blocks"))


def ocr_page_text(ocr: DataFrame) -> DataFrame:
    """Text of read-back pages: LINE texts joined by line feeds."""
    lines = F.filter(F.coalesce("blocks", F.array()), lambda b: b["type"] == "LINE")
    return ocr.select("doc_id", "page", F.array_join(F.transform(lines, lambda b: F.coalesce(b["text"], F.lit(""))), "\n").alias("text"))


# ---------------------------------------------------------------- entity files

def write_entities(documents: DataFrame, path: str, mode: str = "append", by_document: bool = False) -> None:
    """Entity files as JSON lines (S7); see ``aggregate.entities_document``."""
    stamped = documents.withColumn("processedAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    _write_json(stamped.select(*ENTITIES_FIELDS), path, mode, by_document)


def read_entities(spark: SparkSession, path: str, docs: DataFrame | None = None, multi_line: bool = False) -> DataFrame:
    """Entity rows of stored entity files; with ``docs``, documents without a file give no entities but a row."""
    files = spark.read.schema(ENTITIES_DOCUMENT).option("multiLine", multi_line).option("recursiveFileLookup", "true").json(path)
    rows = files.select(F.col("documentId").alias("doc_id"), F.posexplode("entities").alias("ord", "e")).select(
        "doc_id", F.col("e.page").alias("page"), "ord", F.col("e.type").alias("type"),
        F.col("e.startOffset").alias("start_offset"), F.col("e.endOffset").alias("end_offset"),
        F.col("e.text").alias("text"), F.col("e.source").alias("source"), F.col("e.confidence").alias("confidence"))
    return rows if docs is None else docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(rows, "doc_id", "left")


# ---------------------------------------------------------------- reports

#: Neighbouring sections that are written by the same task.
SECTIONS_PER_TASK = 1000


def write_reports(sections: DataFrame, path: str, mode: str = "append", by_document: bool = False) -> None:
    """Report sections in order (S9): a parquet table, or text under ``user_id=…/doc_id=…`` with ``by_document``.

    Stretches of a document's sections are spread by hash and sorted, so a long one is written by many tasks and the
    sections are made once; ``section`` gives their order.
    """
    key = ["user_id", "doc_id", "section"]
    ordered = sections.select(*key, "body").repartition("doc_id", F.floor(F.col("section") / SECTIONS_PER_TASK)).sortWithinPartitions(*key)
    if by_document:
        ordered.select("user_id", "doc_id", F.col("body").alias("value")).write.mode(mode).partitionBy("user_id", "doc_id").text(path)
    else:
        ordered.write.mode(mode).parquet(path)
