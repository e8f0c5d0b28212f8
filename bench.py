"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labweave.session import build_session  # noqa: E402
from labweave.suite.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "plan_assembly", "plan_flow_series", "plan_reaction_series", "s2_sheet_region", "c2_numeric_coercion", "c4_digits_clean",
    "f2_mean_fill", "u2_multi_window", "d2_sample", "d3_split", "r1_structure_densities", "j1_material_lookup", "j3_derived_lookup",
    "j8_large_dimension_lookup", "n2_union_outer", "a1_pairwise_correlation", "a1_wide_correlation", "a3_distinct",
    "a6_regression_metrics", "a10_bin_distribution", "a11_pair_histograms", "a13_normal_qq", "a15_response_surface",
    "w1_frequency", "w2_equal_width_bins", "w3_residual_rank", "t1_top_k", "e1_full_factorial", "e2_saltelli_quantised",
    "e5_all_outputs", "e4_bootstrap_widths", "g1_chained_imputer", "m1_random_forest", "m3_gradient_boosting", "m13_batch_scoring",
    "x1_partial_dependence", "x3_linear_shapley", "x4_tree_contributions", "x5_sampled_shapley",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's hot paths
    times = {}
    for name in names:
        times[name] = round(run(spark, sf_dir, name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
