"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every query is
run whole, into the ``noop`` sink, so that all rows and columns are computed. One short query
runs first so that starting the engine is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lagscope.plans.queries import REGISTRY  # noqa: E402
from lagscope.session import build_session  # noqa: E402

HEADLINE = [
    "lag_severity",
    "lag_velocity",
    "group_severity",
    "worst_group_topic",
    "problematic_partitions",
    "last_commit_at",
    "catch_up_minutes",
    "partition_health",
    "partition_hotspots",
    "leader_fair_share",
    "config_delta_topics",
    "section_chunks",
    "keyword_tags",
    "incident_chunks",
    "vector_topk",
    "similar_incidents",
    "runbook_search",
    "validated_recs",
    "ranked_recs",
    "list_recommendations",
    "produce_rate",
    "alert_states",
    "ttl_dedup",
    "json_dead_letter",
    "messages_per_minute",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("groups_monitored")
    times = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
