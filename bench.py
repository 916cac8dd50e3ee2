"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fallline.plans.registry import REGISTRY
from fallline.session import local_session

HEADLINE = (
    "load_runs",
    "segments",
    "segments_flat",
    "area_metrics",
    "bearing_distribution",
    "bearing_stats",
    "rollup_country",
    "rollup_histogram",
    "lat_histogram",
    "lat_bearing_grid",
    "metric_ecdf",
    "gini",
    "frontend_table",
    "path_nodes",
    "graph_summary",
    "geojson_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("fallline-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the engine
    first, best = {}, {}
    for name in names:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            # every row and column is produced, nothing is brought to the driver
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        first[name], best[name] = round(times[0], 3), round(min(times[1:]), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best of the later runs",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "input_rows": {"events": events},
                "spark": spark.version,
                "cores": spark.sparkContext.defaultParallelism,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )


if __name__ == "__main__":
    main()
