"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced with a full-row aggregate (count) after one warm-up
query, so timings are wall-clock of the whole plan, not of the first rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "link_edges",
    "click_edges",
    "degrees",
    "pagerank",
    "closeness",
    "centrality",
    "tfidf_weights",
    "doc_keywords",
    "cluster_keywords",
    "recommend_links",
    "pillars",
    "cluster_distribution",
    "authority_top25",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("LINKLOOM_MASTER", f"local[{cpus}]")
    os.environ.setdefault("LINKLOOM_SHUFFLE_PARTITIONS", cpus)
    from linkloom.plans import catalog
    from linkloom.session import get_session

    spark = get_session()
    only = [q for q in sys.argv[1:] if q in catalog.QUERIES]
    names = only or [q for q in HEADLINE if q in catalog.QUERIES]
    catalog.QUERIES["click_edges"](spark, sf_dir).count()  # warm-up (JVM, codegen)
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).count()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
