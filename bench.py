"""Headline queries on the driver's tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siltscope.plans import catalog  # noqa: E402
from siltscope.session import local_spark  # noqa: E402

HEADLINE = (
    "flagship_worst_documents", "p1_match_lines", "p6_secret_scan", "p8_injection_scan", "p9_hygiene_lines", "p3_review_scan_lines", "p16_file_complexity",
    "p18_ai_pattern_scan", "a11_vibe_index", "a13_enterprise_score", "j1_imports", "j4_circular_imports", "j5_copy_paste", "j13_phantom_imports", "j17_delta",
    "a1_file_scores", "a4_finding_cube", "w2_score_trend", "a30_org_summary", "a31_health_trend", "a37_repetition_risk", "j15_co_change_pairs", "a32_score_outcomes",
    "a25_pr_file_impact", "w7_cap_findings",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_spark(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors, the Python workers and the parquet reader before the clock
    catalog.QUERIES["w1_latest_scan"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"{n}: {times[n]}", file=sys.stderr, flush=True)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    files = spark.read.parquet(f"{sf}/orders.parquet").count()
    rate = {
        "documents_per_sec_line_rules": round(docs / times["p1_match_lines"], 1) if "p1_match_lines" in times else None,
        "source_files_per_sec_hygiene": round(files / times["p9_hygiene_lines"], 1) if "p9_hygiene_lines" in times else None,
        "source_files_per_sec_secrets": round(files / times["p6_secret_scan"], 1) if "p6_secret_scan" in times else None,
    }
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "rates": rate, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
