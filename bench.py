"""Time the headline queries: one warm-up, then the median of BENCH_REPEATS runs, results fully materialised."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from kinweave import adapters
from kinweave.plans.catalog import QUERIES
from kinweave.session import get_session, release

HEADLINE = (
    "get_callers", "get_callees", "get_impact", "impact_path", "get_callers_transitive", "get_supertypes",
    "search_symbols", "undocumented_symbols", "graph_stats", "record_parse", "record_about",
    "records_for_symbol", "context_topk", "rules_by_file", "drift_unresolved", "staged_check", "manifest_diff",
    "debounce_windows", "marker_scan", "bootstrap_records", "sql_objects", "ts_symbols", "index_calls",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session(
        "kinweave-bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="kinweave-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    began = time.perf_counter()
    adapters.knowledge_graph(spark, sf_dir)
    seconds["index_build"] = round(time.perf_counter() - began, 3)
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
