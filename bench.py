"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["topk_bm25", "topk_f2exp", "topk_lmdir", "topk_pl2", "topk_spl", "topk_bm25_k1000", "topk_bm25_maxscore", "topk_bm25_document_blocks", "term_max_impact", "block_max_docid", "score_checksum", "ef_size_report"]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillrank import catalog
    from quillrank.sources.index import index_of

    taken: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        taken[name] = round(time.perf_counter() - start, 3)

    timed("index_build", lambda: index_of(spark, sf_dir))
    catalog.QUERIES["topk_bm25"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles
    for name in HEADLINE:
        timed(name, lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
