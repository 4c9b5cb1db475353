"""Times the headline queries and prints one JSON line.

Every query runs to the ``noop`` sink, which takes all rows and writes nothing. Each is
run once to warm up and then timed; the value is the sum of the best times.
"""

from __future__ import annotations

import json
import os
import time

from ledgerfold.plans.catalog import QUERIES
from ledgerfold.session import build_session, release
from ledgerfold.sources.tables import table

HEADLINE = [
    "journal_scan", "user_view", "department_view", "user_state", "user_history", "snapshot_points", "recover_from_snapshot",
    "tag_view", "department_gate_replies", "dept_exists_as_of", "user_gate_replies", "user_gate_events", "service_replies",
    "search_all_page", "search_terms", "search_field_sorted", "search_stream_pages", "suggest_users", "bm25_documents",
    "dangling_departments", "republish_records", "stream_user_view", "stream_gate",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    events = table(spark, folder, "events").count()
    times = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        times[name] = round(min(timed(spark, name, folder) for _ in range(runs)), 4)
    total = round(sum(times.values()), 3)
    rates = {n: round(events / times[n]) for n in ("user_view", "user_state", "user_gate_replies")}
    print(json.dumps({
        "metric": "event_sourcing_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "rows_per_sec": rates,
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
