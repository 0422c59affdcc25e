"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from basketlens.registry import all_queries
from basketlens.session import build_session

HEADLINE = [
    "missing_profile", "clean_transactions", "cleaning_summary", "category_sales", "outlier_thresholds", "flag_outliers",
    "sensitivity_summary", "customer_features", "customer_base_summary", "rfm_independent", "rfm_sequential",
    "rfm_independent_segment_summary", "rfm_segment_crosstab", "influence_model", "cooks_distance",
    "cluster_profile", "kmeans_fit_summary", "ward_clusters", "anova_cluster_separation_results", "lda_test_predictions",
    "prospect_cluster_summary", "pooled_conjoint", "respondent_conjoint_partworths", "respondent_panel_partworths",
    "respondent_wtp_summary", "conjoint_market_share_prediction", "pve_table", "product_scores",
]
# timed beside the headline list, whose total stays comparable from round to round
MORE = [
    "kmeans_elbow", "kmeans_restart_stability", "conjoint_market_share_gap_analysis", "quantiles_by_slices", "ntile_heavy_ties",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries["range_profile"](spark, folder).collect()  # JVM warm-up
    seconds, began, budget = {}, time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "600"))
    for name in only or [*HEADLINE, *MORE]:
        times = []
        while len(times) < runs and (not times or time.perf_counter() - began < budget):  # once at least, then as time allows
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
    total = sum(v for k, v in seconds.items() if only or k in HEADLINE)
    print(json.dumps({
        "metric": "total query time", "value": round(total, 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
