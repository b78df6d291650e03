"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (data folder), ``BENCH_CPUS`` (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import QUERIES  # noqa: E402

HEADLINE = [
    "combined_filters_and_rules",
    "union_of_sources",
    "grouped_summary",
    "moments",
    "distinct_counts",
    "medians",
    "quantile_interpolations",
    "autocorrelation",
    "summary_over_several_sources",
    "cumulative_metrics",
    "iv_ranking_of_loans",
    "outlier_counts_per_rule",
    "distribution_of_a_skewed_variable",
    "many_numeric_bands_assigned",
    "category_bands_joined",
    "loss_rate_bands_rising",
    "bands_within_parents",
    "chain_built_and_scored",
    "chain_scored",
    "table_of_segments",
    "table_of_cells",
    "pivot_with_subtotals",
    "pivot_of_other_aggregates",
    "columns_fit_for_pivots",
    "chains_side_by_side",
    "loss_rates_of_joined_accounts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bandwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's worker threads and file reader before the clock.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
