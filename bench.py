"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import catalog  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = ("session_summary", "peak_in_window", "median_gap", "split_runs", "extract_features", "validate_events", "mask_text", "auth_burst",
            "success_after_burst", "request_rate", "automation", "attack_patterns", "multi_vector", "evaluate_rules", "clusters", "cluster_summary",
            "timeline", "graph_edges", "risk_score", "robust_baseline", "isolation_forest", "kpis", "live_counters")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries, times, tables = catalog.queries(), {}, {}
    # tables that ingest and detection would have stored before: timed apart from the queries that read them
    from tidewatch.plans.catalog import base, correlate, timeline
    for name, build in (("events", base.events), ("cluster_members", correlate.members), ("cluster_stages", correlate.stages), ("cluster_links", correlate.links),
                        ("event_groups", timeline.groups)):
        start = time.time()
        build(spark, sf_dir)
        tables[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_and_stored_tables_total", "value": round(sum(times.values()) + sum(tables.values()), 3), "unit": "sec", "queries": times, "stored_tables": tables,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
