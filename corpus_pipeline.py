"""The corpus pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachado.llm import credentials, ngram_join, packing, quality, tiling
from tachado.llm.queries import vocabulary
from tachado.llm.tables import table, written


#: Bytes of texts that go to a Python worker at once, in place of 64 MB: a worker holds a batch, its words and what it gives back.
BATCH_BYTES = 8 << 20


def in_small_batches(stage: Callable) -> Callable:
    """A stage whose Python workers, and those of what it returns, get texts in small batches."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return bounded


@in_small_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores below one half go."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


@in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of runs of five words are alike to 0.8 or more one row stays, that of the smallest doc_id."""
    return ngram_join.first_of_each(docs, size=5, percent=80)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by marks; n_chars follows the text."""
    return credentials.mask(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 1024 ids, neighbours on the curve together."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", decontaminate),
          ("secret scans", mask_secrets), ("packing", pack)]

#: Classification, tokenizing and packing are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
