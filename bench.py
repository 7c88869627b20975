"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

HEADLINE = [
    "flagship",
    "sum_over_time_tumbling",
    "sum_over_time_sliding",
    "window_not_in_panes",
    "selector_regex",
    "agg_topk_by",
    "agg_quantile_by",
    "join_ignoring",
    "join_group_left",
    "set_unless",
    "program_regex",
    "decode_json",
    "lineitem_sum",
    "lineitem_price_sliding",
    "orders_top",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from loglathe.catalogue import QUERIES
    from loglathe.session import session

    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):  # the first compiles and warms files
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs[1:])[RUNS // 2], 3)
    print(json.dumps({"metric": "headline queries, sum of medians of 3 after a warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
