"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is built from raw tables (its own context: nothing is shared
between queries) and executed to the end with the ``noop`` sink, so the
time covers the full plan without pulling rows to the driver.  One tiny job
runs first so JVM/session start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartwalk.plans.registry import load_all  # noqa: E402
from cartwalk.session import get_spark  # noqa: E402

HEADLINE = [
    "rec_topk",            # fit the walk model on train, top-10 for every test session
    "eval_holdout",        # all metrics at 5 and 10
    "rp3_similarity",      # the item-item self-join
    "sim_top_items",       # query encoding + cosine retrieval + zero fill
    "pipe_query",          # encode, accumulate, recommend, decode
    "feat_cyclic_literal", # enrichment
    "prof_length_stats",   # profiling
    "time_4h_period",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up is not part of any query
    reg = load_all()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        df = reg[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
