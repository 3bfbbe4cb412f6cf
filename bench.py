"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times into the noop sink; its figure is the median.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from quarry.plans import QUERIES
from quarry.session import build_session

HEADLINE = (
    "pricing_summary", "join_inner", "join_range_price_band", "join_as_of", "anti_not_exists", "corr_scalar", "group_argmax_ties", "deviation_window", "running_sum", "recursive_levels",
    "describe", "crosstab", "corr_matrix", "bow_counts", "tfidf", "word_ngrams", "cosine_topk", "apriori_itemsets", "kmeans_step", "information_gain", "ols_multi", "dft_daily", "daily_windows", "session_gaps",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(median(taken[1:]), 4)
    print(json.dumps({"metric": "total of median query times", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
