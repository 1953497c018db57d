"""Times headline queries: one JSON line ``{"metric", "value", "unit", "queries", "sf"}``. Warm runs, the median of three."""

import json
import os
import statistics
import time

from factorloom.queries import QUERIES, load_all
from factorloom.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bars_events", "bars_suppliers", "factor_many_in_one_plan", "factor_nested_cross_section_of_history", "factor_ema", "factor_ts_rank", "guard_counts", "metric_rank_ic", "metric_alpha_decay",
    "backtest_summary", "backtest_suppliers", "backtest_equity", "robust_walk_forward", "robust_placebo", "robust_bootstrap", "review_root_cause", "catalog_redundancy", "catalog_articles", "text_repeated_lines", "text_number_spans", "table_continued",
)


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of median warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
