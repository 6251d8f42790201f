"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

import registry
from corrspark.session import build_session

HEADLINE = (
    "clean_service_pipeline", "clean_full_pipeline", "text_versions", "cosine_rank", "correlate_topk", "hybrid_rank",
    "keyword_exact", "keyword_cascade", "text_correlation", "rank_metrics", "rank_report", "topk_wide",
    "upsert_last_wins", "typed_links", "cpe_aggregate", "cpe_mask_products", "rating_distribution", "top_links_per_year",
    "top_vendors_products", "graph_edges", "sample_per_year", "completeness", "stream_upsert",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM, the Python workers and the file listing before the clock
    registry.QUERIES["record_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    registry.QUERIES["clean_stems"](spark, folder).limit(1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
