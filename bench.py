"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with a no-op sink (``write.format("noop")``),
so the whole plan runs without pulling rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "combined_txns",
    "agp_daily",
    "category_txns",
    "account_health",
    "exposure_dedup",
    "exposure_split",
    "engagement_variant",
    "combined_variant",
    "ecomm_variant",
    "redemptions_variant",
    "clips_variant",
    "tests_all",
    "recon_excluded",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from expkit.plans.catalog import QUERIES
    from expkit.sources.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2), app_name="expkit-bench")
    # Warm-up: JVM, parquet footers and the adapter views of this folder.
    QUERIES["recon_baseline"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
