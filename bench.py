"""Time the headline queries; prints one JSON line.

``build_*`` are the shared tables (written once per application, read by every report). Every number is
the better of two runs in one session, so the first run warms the JVM up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tillstone.plans.mart import Mart
from tillstone.registry import REPORTS

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2

BUILDS = [
    "facts",
    "profiles",
    "category_totals",
    "scaled",
    "segmented",
    "spend_positions",
    "ranked_categories",
    "month_steps",
]
HEADLINE = [
    "eda_summary",
    "revenue_by_category",
    "revenue_by_city",
    "monthly_revenue",
    "payment_mode_distribution",
    "order_value_histogram",
    "order_value_center",
    "category_discount_pivot",
    "rfm_scores",
    "silhouette_by_cluster",
    "segment_box_stats",
    "top20_customers",
    "segment_contribution",
    "cohort_revenue",
    "category_cumulative",
    "mom_growth",
    "segment_category_matrix",
    "return_rate_by_segment",
    "segment_demographics_export",
    "vw_kpi_summary",
    "vw_category_performance",
    "vw_monthly_trend",
    "vw_high_value_customers",
    "quintile_pareto",
    "bi_kpi_long",
    "pk_check",
    "fk_check",
    "column_profile",
    "skew_report",
    "kmeans_segments",
    "sample_customers",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tillstone-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reports = {report.__name__: report for report in REPORTS}
    best: dict[str, float] = {}

    def note(name: str, seconds: float) -> None:
        best[name] = min(seconds, best.get(name, seconds))

    for _ in range(RUNS):
        mart = Mart.from_star(spark, FOLDER, clustering_method="lloyd")
        for name in BUILDS:
            note(f"build_{name}", timed(lambda: getattr(mart, name)))
        for name in HEADLINE:
            note(name, timed(lambda: reports[name](mart).write.format("noop").mode("overwrite").save()))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of shared tables and headline queries",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in best.items()},
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
