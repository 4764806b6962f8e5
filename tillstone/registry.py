"""Every named query: key -> function of a session and a folder of star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstone.plans import boards, checks, eda, rfm, sales, views
from tillstone.plans.mart import Mart, open_mart

REPORTS: list[Callable[[Mart], DataFrame]] = [
    eda.eda_summary,
    eda.revenue_by_category,
    eda.revenue_by_age_group,
    eda.payment_mode_distribution,
    eda.monthly_revenue,
    eda.order_value_histogram,
    eda.order_value_center,
    eda.revenue_by_city,
    eda.category_discount_pivot,
    eda.top5_categories,
    eda.revenue_by_gender,
    rfm.rfm_base,
    rfm.rfm_scores,
    rfm.rfm_scaled,
    rfm.kmeans_sweep,
    rfm.kmeans_segments,
    rfm.lloyd_segments,
    rfm.silhouette_by_cluster,
    rfm.cluster_summary,
    rfm.segment_distribution,
    rfm.segment_box_stats,
    rfm.freq_vs_monetary,
    rfm.segment_revenue_share,
    rfm.segment_report,
    sales.top20_customers,
    sales.segment_contribution,
    sales.cohort_revenue_12,
    sales.category_cumulative,
    sales.mom_growth,
    sales.segment_category_matrix,
    sales.return_rate_by_segment,
    sales.segment_demographics_export,
    views.vw_kpi_summary,
    views.vw_rfm_segments,
    views.vw_segment_summary,
    views.vw_category_performance,
    views.vw_monthly_trend,
    views.vw_city_performance,
    views.vw_segment_x_category,
    views.vw_high_value_customers,
    sales.quintile_pareto,
    sales.cohort_revenue,
    boards.dash_kpis,
    boards.dash_segment_revenue,
    boards.dash_segment_count,
    boards.dash_segment_avg,
    boards.bi_kpi_long,
    boards.bi_by_category,
    boards.bi_by_city,
    boards.bi_by_age_group,
    boards.bi_monthly_trend,
    boards.bi_high_value_customers,
    boards.bi_raw_customers,
    boards.bi_raw_transactions,
    boards.bi_raw_rfm,
    checks.pk_check,
    checks.fk_check,
    checks.column_profile,
    checks.sample_customers,
    checks.date_spine_revenue,
    checks.weighted_bucket,
    checks.skew_report,
    checks.domain_check,
    checks.net_amount,
    checks.csv_round_trip,
]


def query(report: Callable[[Mart], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report(open_mart(spark, folder))

    run.__name__ = report.__name__
    run.__doc__ = report.__doc__
    return run


QUERIES = {report.__name__: query(report) for report in REPORTS}
