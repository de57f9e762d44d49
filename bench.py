"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "a1_jevons_index", "a4_national_index", "a6_contributions", "a9_fixed_base_index", "d3_iqr_bounds", "d5_clean_quotes",
    "d6_cleaning_counts", "j1_comparable_pairs", "v6_all_metrics", "v8_monthly_correlation", "w6_feature_vectors",
    "w7_persistent_pattern", "x4_confirm_sources", "x5_detect_shocks", "x8_combined_analysis", "q6_route_window_matrix",
)


def main() -> None:
    from fareindex.checks import load
    from fareindex.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries = load().QUERIES
    # One small query first, so that the start of the JVM is not charged to the first headline query.
    queries["a14_source_volume"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
