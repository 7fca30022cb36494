"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed
runs per query after one warm-up.  Results go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from querygrove.plans import catalogue
from querygrove.session import local_session

HEADLINE = [
    "cur_dedup_norm", "pf_counts", "sc_ngram_jaccard", "sc_schema_recall", "ds_cap_per_question", "ds_sample_half",
    "rw_total", "ev_accuracy", "cat_schema_text", "vl_matches", "vl_refine", "ex_labels", "ds_training_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, sum of median wall times", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
