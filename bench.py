"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints ONE JSON line. Each query is fully
executed into Spark's ``noop`` sink (no driver collect), after warm-up
queries on the smoke tables that pay for JIT and Python-worker start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taintrank.plans.registry import REGISTRY  # noqa: E402
from taintrank.session import local_session, release_tables  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"

HEADLINE = (
    "m7_dense_metrics",         # flagship: dense top-100 + all ranking measures
    "k7_dense_topk",
    "k1_bm25_top100",
    "m7_bm25_metrics",
    "k2_cross_rerank",          # BM25 -> Python cross scorer -> re-rank
    "k7_bi_rerank",             # BM25 -> encoders -> native dot -> re-rank
    "m7_event_metrics",         # 100k-row run, 1.5k queries
    "w6_running_relevant",      # skew-safe running counts
    "j11_leaked_triples",       # contamination build
    "g5_kl_divergence",
    "l7_kl_div_listwise",
    "w4_ecdf",                  # 600k-row score sample
    "b2_box_stats",
    "b3_kde",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm-up on the smoke tables: JVM JIT and Python workers, not the measured data
    for name in ("p4_binary_relevance", "k7_dense_topk", "k2_cross_rerank"):
        REGISTRY[name](spark, WARMUP_DIR).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        release_tables(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
