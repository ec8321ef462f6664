"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times; the median counts.
Results go to a no-op sink, so whole outputs are computed and none collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from glasswatch.queries import QUERIES, load_all  # noqa: E402
from glasswatch.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "scan_documents_findings", "scan_seeded_prompts", "scan_turns_by_stage", "index_quarantine_pages", "content_hits_seeded",
    "redact_prompts", "decide_prompts", "guard_verdicts", "tool_call_router", "session_window_6", "output_lines",
    "weighted_bands", "content_free_alerts", "asof_policy", "detection_log", "fleet_cube", "alert_windows_tumbling",
    "alert_sessions", "aibom_summary_by_device", "stream_scan_prompts",
)
# Queries whose input text volume gives a throughput.
VOLUME = {"scan_documents_findings": ("documents", "text"), "redact_prompts": ("documents", "text"),
          "session_window_6": ("conversations", "text"), "index_quarantine_pages": ("pages", "html"),
          "stream_scan_prompts": ("documents", "text")}


def main() -> None:
    load_all()
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        spent = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
    rates = {}
    for name, (table, column) in VOLUME.items():
        if name in times:
            r = spark.read.parquet(f"{SF_DIR.rstrip('/')}/{table}.parquet").agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
            rates[name] = {"rows_per_sec": round(r.n / times[name]), "mb_per_sec": round(r.b / times[name] / 1e6, 2)}
    spark.stop()
    print(json.dumps({"metric": "headline guardrail queries, sum of warm medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").split("sf")[-1], "cpus": int(CPUS),
                      "runs": RUNS, "throughput": rates}))


if __name__ == "__main__":
    main()
