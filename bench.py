"""Time the headline queries in a warm session and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (threads), BENCH_RUNS (timed runs, median reported).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from jobtide.bindings import run
from jobtide.session import build_session

HEADLINE = (
    "ranking_run", "posting_scores", "search_page", "search_total", "job_listings_view", "enrichment_active_view",
    "companies_list_view", "job_details", "company_profiles", "duplicates_resolved", "company_merge", "common_industries",
    "types_assigned_from_runs", "override_backfill", "tech_assignments", "events_near_runs", "query_history_by_text",
    "normalized_documents", "page_texts", "dedup_keys", "quality_stats", "dashboard_stats", "jobs_by_size", "job_result_sink",
    "ingest_statuses", "ingest_postings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("dashboard_stats")  # start the JVM's code paths before the first timing
    timings = {}
    for name in HEADLINE:
        if runs > 1:
            once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
                "spark": spark.version, "shuffle_partitions": int(cpus), "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
