"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from skerry.plans import catalogue
from skerry.session import session

HEADLINE = (
    "count_star", "scan_filter_project", "scalar_agg", "group_agg", "count_distinct", "pricing_summary", "forecast_revenue",
    "inner_join_equi", "three_table_chain", "star_join", "top_customers", "semi_exists", "anti_not_exists", "corr_scalar",
    "top_n_sort", "win_running", "win_lag_lead", "union", "hyg_find_duplicates", "hyg_dedup_first", "stats_columns", "pipe_dedup", "fts_and_terms",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = session("bench", f"local[{cpus}]", settings)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
