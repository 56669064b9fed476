"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
HEADLINES = [
    "q_source_keep_rate", "q_clean_text", "q_normalize_report", "q_drop_boilerplate", "q_clean_summary", "q_split_summary", "q_corpus_totals", "q_zipf",
    "q_pack_offsets", "q_html_documents", "q_lang_predict", "q_bleu_counts", "q_event_windows",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from granary.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(3):  # the first warms up; the better of the others counts
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None,
        "documents": docs, "clean_docs_per_second": round(docs / seconds["q_clean_summary"], 1),
    }))


if __name__ == "__main__":
    main()
