"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is run to completion over all
its rows (a no-op write), once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from rollbook.catalog import QUERIES
from rollbook.session import local_session

HEADLINE = [
    "q_current_mrr", "q_invoice_mrr", "q_first_order", "q_initial_current", "q_licence_check", "q_customer_value", "q_tenure_expansion", "q_churn_features",
    "q_advisor_report", "q_enrich_orders", "q_contract_net_value", "q_split_discount", "q_fleet_contracts", "q_subscription_base", "q_migration_export",
    "q_last_invoice_qty", "q_exclude_dead_plans", "q_odometer", "q_odometer_audit", "q_active_stats", "q_activation_funnel", "q_screen_time", "q_job_counts",
    "q_fleet_trips", "q_scd2_flag", "q_user_marketing", "q_date_spine", "q_interval_join", "q_asof_reading", "q_distinct_on", "q_explode_lookup", "q_count_distinct",
    "q_describe", "q_correlation", "q_label_encode",
]


def run(spark, root: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, root, name)
        seconds[name] = round(run(spark, root, name), 3)
    scale = re.search(r"sf([\d.]+)", root)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
