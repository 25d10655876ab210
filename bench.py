"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import time

from lumenlog.plans import catalog
from lumenlog.session import session

HEADLINE = (
    "event_search_page", "event_facets", "template_dedup", "effective_scores_hourly", "dashboard_overview", "grouped_event_scores", "source_routing_first_match", "normal_behavior_kept", "json_unpack", "redact_secrets", "redact_secrets_whole", "top_events_by_criterion",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
