"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. ``BENCH_QUERIES`` may
list names (comma separated); by default every headline query runs. Each query is
run once to warm up and then timed; the result is fully computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pluvia import get_session
from pluvia.plans.catalog import QUERIES

HEADLINE = [
    "score_report", "error_scores", "csi_all", "ets_all", "csi_neighbourhood", "csi_pooled_rollup",
    "past_join", "future_join", "lead_pairs", "valid_keys", "multi_source", "with_predictions",
    "sample_weights", "rolling_weights", "new_rows_only", "high_water_filter", "advance_marks",
    "latest_per_key", "key_difference", "time_range_scan", "floor_10min", "scan_rules",
    "train_stats", "transforms", "cmax", "repeat_median", "gap_fill", "circular_runs",
    "asof_height", "asof_offset", "scan_in_minutes", "geostationary_to_latlon", "parallax_shift",
    "polar_to_latlon", "interp_grid", "interp_static_weights", "satellite_frames",
    "satellite_parallax_frames", "radar_frames", "objects", "object_stats", "despeckle",
    "despeckle_time", "warp_nearest", "warp_bilinear", "evolve", "motion_block", "extrapolate",
    "ensemble_mean", "score_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session(
        f"local[{cpus}]",
        "pluvia-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        # The tables are small and the cores few: keep one partition per core.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="32k",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
