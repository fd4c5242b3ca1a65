"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
Every query runs in full into a no-op sink, so nothing is cut short and nothing goes to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from causeway import catalog  # noqa: E402
from causeway.session import local_session  # noqa: E402

HEADLINE = [
    "parse_timestamps", "raw_log_assemble", "assemble_tags", "normalize_message", "incident", "root_cause_global",
    "severity_score_per_flow", "trend", "host_impact", "service_impact", "flow_matrix", "anomaly_breakdown",
    "tag_cooccurrence", "duplicate_count", "recovery_timeline", "top_error_messages", "tag_sets", "overview",
    "flow_key_profile", "isolate_flow", "burst_windows_30s", "log_gaps_per_host", "error_density", "event_chain",
    "cross_host_cascade", "incident_window", "pattern_drilldown", "timeline", "top_raw_errors", "network_evidence",
    "network_evidence_documents", "pseudonymize", "audit_model_replies", "source_fingerprint", "alert_feed", "incident_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
