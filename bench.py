"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the no-op sink (full evaluation, no
driver collection). The feature table is the expensive step; every query
starts from the parquet tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

WARM_RUNS = 2
HEADLINE = ["page_features", "feature_means", "dedup_pages", "bucketize", "rf_scores",
            "html_page_features", "title_search_top3", "suggestions", "page_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from quillrank.plans import load_all
    from quillrank.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    reg = load_all()
    # Warm the JVM (class loading, codegen caches) on the smallest table.
    reg.QUERIES["page_id_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # One cold pass pays the JIT compilation of the regex and lambda paths;
    # then WARM_RUNS warm passes, each query reported at its fastest warm run
    # (the shared VM's CPU steal makes single runs noisy).
    cold = {}
    warm_runs = []
    for i in range(1 + WARM_RUNS):
        times = cold if i == 0 else {}
        for name in HEADLINE:
            t0 = time.time()
            reg.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        if i:
            warm_runs.append(times)
    times = {name: min(run[name] for run in warm_runs) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "warm_runs": WARM_RUNS, "cold_total": round(sum(cold.values()), 3), "cold_queries": cold, "sf": sf, "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
