"""The whole batch: checks, scores, segments, reports and the BI bundle in one Spark application."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillstone.plans import boards, checks, eda, rfm, sales
from tillstone.plans.mart import Mart
from tillstone.plans.views import VIEWS, register_views
from tillstone.sources.files import save_tables, write_bundle, write_csv


class BrokenKeysError(ValueError):
    """A base table breaks its primary or foreign key."""


def check_keys(mart: Mart) -> None:
    """Parents before children: unique ids first, then references."""
    for row in checks.pk_check(mart).collect():
        if row["null_keys"] or row["duplicate_keys"]:
            raise BrokenKeysError(
                f"{row['table_name']}.{row['key_columns']}: {row['null_keys']} null, "
                f"{row['duplicate_keys']} repeated keys"
            )
    for row in checks.fk_check(mart).collect():
        if row["orphan_keys"]:
            raise BrokenKeysError(f"{row['child_table']}: {row['orphan_keys']} unknown {row['key_column']} values")


EDA = [
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
]

SEGMENTS = [
    rfm.cluster_summary,
    rfm.segment_distribution,
    rfm.segment_box_stats,
    rfm.freq_vs_monetary,
    rfm.segment_revenue_share,
    rfm.segment_report,
    rfm.silhouette_by_cluster,
    rfm.rfm_scaled,
    rfm.kmeans_sweep,
]

QUALITY = [checks.domain_check, checks.column_profile, checks.date_spine_revenue, checks.skew_report]

SALES = [
    sales.top20_customers,
    sales.segment_contribution,
    sales.cohort_revenue_12,
    sales.category_cumulative,
    sales.mom_growth,
    sales.segment_category_matrix,
    sales.return_rate_by_segment,
    sales.quintile_pareto,
    sales.cohort_revenue,
]

BOARD = [boards.dash_kpis, boards.dash_segment_revenue, boards.dash_segment_count, boards.dash_segment_avg]


def run(mart: Mart, out: str, fmt: str = "parquet", strict: bool = True) -> dict[str, str]:
    """Write every report below ``out`` and return their paths; the first failure ends the run."""
    if strict:
        check_keys(mart)
    paths: dict[str, str] = {}
    groups = {"eda": EDA, "segments": SEGMENTS, "sales": SALES, "views": VIEWS, "dashboard": BOARD, "quality": QUALITY}
    for folder, reports in groups.items():
        tables = {report.__name__: report(mart) for report in reports}
        paths |= write_bundle(tables, f"{out}/{folder}", fmt)
    paths |= write_bundle(boards.bi_bundle(mart), f"{out}/bi", fmt)
    if not mart.rejected.isEmpty():
        paths |= write_bundle({"rejected_lines": mart.rejected}, out, fmt)
    for name, table in {"rfm_segments": mart.rfm_segments, "sql_summary": sales.segment_demographics_export(mart)}.items():
        paths[name] = f"{out}/{name}"
        write_csv(table, paths[name])
    return paths


def publish(mart: Mart, database: str) -> list[str]:
    """Base tables as catalog tables, parents first, and the report views as temporary views."""
    base: dict[str, DataFrame] = {
        "customers": mart.customers,
        "transactions": mart.transactions,
        "rfm_segments": mart.rfm_segments,
    }
    save_tables(base, database)
    return register_views(mart)
