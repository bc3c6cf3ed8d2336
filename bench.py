"""Headline-query benchmark: prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (3).
Each query is executed with a no-op sink (full execution, no driver
collect); the reported time is the warm median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartlake.plans.session import get_session  # noqa: E402
from cartlake.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "rtl_top_products", "rtl_spend_breakdown", "rtl_popular_in_category", "rtl_last_n_orders",
    "rtl_purchase_history", "rtl_total_reconcile", "cht_upsert_messages", "cht_history_page",
    "mem_put", "mem_search", "trc_latency_errors", "evl_tool_routing", "evl_scorer_matrix",
    "rag_chunk_documents", "rag_topk_batch", "rag_sync_plan",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in REGISTRY]
    spark = get_session(f"local[{cpus}]", cpus * 2, app="cartlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    per = {}
    for n in names:
        fn = REGISTRY[n][0]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        per[n] = round(statistics.median(times), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_warm_median_query_seconds", "value": round(sum(per.values()), 4),
                      "unit": "sec", "queries": per, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
