"""Time the headline queries (or all, with --all) on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tachado.plans.queries import QUERIES  # noqa: E402
from tachado.session import configure  # noqa: E402

HEADLINE = [
    "mask_documents", "detect_every_rule", "detect_user_rules", "resolve_overlaps", "mask_with_model_and_config", "model_entities",
    "report_sections", "entities_document", "document_summary", "residual_scan", "ocr_pages", "attach_words", "page_offsets",
    "locate_tolerant", "locate_cascade", "latest_status", "error_alarms", "latency_p99", "reprocess_requests", "stream_masked",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in names:
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    pages = spark.read.parquet(f"{folder}/documents.parquet").count()
    begin = time.time()
    QUERIES["mask_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    warm = time.time() - begin
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "mask_pages_per_second": round(pages / warm, 1), "mask_seconds_warm": round(warm, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
