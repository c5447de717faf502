"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the local cores (default 8).
All queries are run once to warm up, then each once more before the median of three runs
is taken. A run builds the plan and writes all result rows to the no-op sink, so nothing is
skipped or collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "suite_fused",
    "suite_sequential",
    "check_row_count",
    "check_null_on_view",
    "check_uniqueness_key",
    "check_uniqueness_columns",
    "check_freshness",
    "check_regex_name",
    "check_range",
    "check_set_text",
    "check_referential_clean",
    "check_referential_fan_out",
    "check_distribution",
    "view_join_inner",
    "view_join_skewed",
    "view_group_by",
    "view_order_limit",
    "view_union",
    "result_history",
    "result_check_state",
    "execution_summary",
    "alert_deliveries",
    "lineage_run_states",
    "lineage_edges",
    "lineage_downstream",
    "workflow_replay_events",
    "access_batch_check",
    "access_decisions_with_rules",
    "windowed_checks_batch",
    "file_row_counts",
)


def timed(spark, sf_dir: str, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(3)), 4)
    folder = os.path.basename(sf_dir.rstrip("/"))
    scale = float(folder[2:]) if folder.startswith("sf") else None
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
