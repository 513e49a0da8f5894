"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Each query runs to its last row into a sink that discards them;
the best of BENCH_RUNS (default 3) runs counts.
"""

import json
import os
import pathlib
import re
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from gridseries.session import local_session  # noqa: E402
from workload.queries import all_queries  # noqa: E402

HEADLINE = [
    "region_box",
    "regions_join",
    "regions_mean",
    "regions_supplier",
    "coverage_quality",
    "weighted_mean",
    "fill_gap_3",
    "fill_multi",
    "clim_day",
    "clim_map",
    "anomaly_table",
    "anomaly_by_nation",
    "grid_to_anomaly",
    "persistence_eval",
    "persistence_meta_by_nation",
    "grid_to_forecast",
    "regions_to_forecast",
    "metrics_by_type",
    "histogram_orders",
    "kde_orders",
    "acf_by_nation",
    "ingest_plan",
    "anomaly_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
