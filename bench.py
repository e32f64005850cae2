"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from railflow.session import local_session
from railflow.staging import drop_stages

HEADLINE = (
    "od_share od_hour_share station_mobility od_avg_time rank_dist tap_pairs trip_index prediction_table "
    "sequence_samples nearest_station centres habit_pairs last_irregular samples_base samples_ext samples_multi "
    "samples_dense samples_ext_dense station_vectors markov_hits accuracy_curve ap_segments route_ratio personal_routes path_shares matched_traces"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["od_count"](spark, sf_dir).count()  # start the JVM before timing
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
