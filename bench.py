"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced with the ``noop`` sink (full execution, nothing pulled
to the driver).  One warm-up run of a tiny query absorbs JVM start-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_extract",            # pages → Markdown (the flagship)
    "q_selector_hits",      # node table × selector table at corpus scale
    "q_url_reject",         # admission verdicts over the request log
    "q_dns_verdict",        # admission + DNS join
    "q_cache_replay",       # as-of replay of the shared cache
    "q_admission",          # per-actor admission cap
    "q_usage_daily",        # daily counter rollup
    "q_report_first_party", # period report
    "q_store_upsert",       # last-write-wins store merge
    "q_words",              # word counts over the document corpus
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PAGEMILL_MASTER", f"local[{cpus}]")
    from pagemill.plans import QUERIES
    from pagemill.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM, Python workers, parquet footer caches
    QUERIES["q_scanner_paths"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
