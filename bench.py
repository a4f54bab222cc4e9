"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (every row and column is
produced, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.registry import QUERIES, load_all  # noqa: E402
from revlens.session import local_session  # noqa: E402

HEADLINE = [
    "revenue_impact",        # flagship: dedup -> clean -> mine -> map -> score sentences -> roll-up
    "absa_enriched",         # sentiment + features + wide aspects
    "feature_table",
    "remove_duplicates",
    "lexicon_intensity",
    "mine_candidates",
    "tfidf",
    "roc_auc",
    "average_precision",
    "confusion_matrix",
    "ece",
    "stratified_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:]] or HEADLINE
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="revlens-bench")
    # warm-up: JVM JIT and Python worker start, not timed
    QUERIES["confusion_matrix"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
