"""Benchmark the headline queries.

Runs each headline query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "headline_total", "value": <sec>, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with the ``noop`` sink (full plan, no
collect). Every query runs three times in the same session; "queries" has the
fastest run (JVM/JIT and Python-worker start-up are paid once, as on a long-lived
cluster session), "median" the middle one. BENCH_RUNS changes the repeat count.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "chunks",
    "document_record",
    "page_text",
    "page_elements",
    "page_selectors",
    "retrieve_lexical",
    "retrieve_dense",
    "context",
    "test_cases",
    "feature_detect",
    "json_normalize",
    "order_totals",
    "page_structure",
    "case_context",
    "script_prompts",
    "kb_retrieve",
    "retrieve_ann",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="docmill-bench-")
    from docmill.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus), app_name="docmill-bench",
                        extra={"spark.driver.memory": "16g",
                               "spark.local.dir": scratch})
    from docmill.plans.registry import QUERIES
    timings, middle = {}, {}
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        timings[name] = round(min(took), 3)
        middle[name] = round(statistics.median(took), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "median": middle, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "runs": runs}
    print(json.dumps(out))
    from docmill.session import remove_scratch
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
