"""The report views a BI tool reads, as DataFrames and as temporary views for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.functions.dates import month_name
from tillstone.functions.numbers import money
from tillstone.plans.eda import customer_attribute_totals
from tillstone.plans.mart import Mart
from tillstone.plans.measures import average_order, monthly_totals, return_rate, rolled_up, totals_by
from tillstone.plans.sales import segment_category_totals, segment_profile
from tillstone.schemas import HIGH_VALUE_TIERS

# The KPI column of each tier.
TIER_COLUMNS = {
    "Champions": "champions",
    "Loyal Customers": "loyal_customers",
    "At Risk": "at_risk",
    "Lost / Inactive": "lost_inactive",
}


def vw_kpi_summary(mart: Mart) -> DataFrame:
    """Nine KPIs in one row. Customer ids are unique in all three tables, so counting rows per customer
    replaces the five distinct counts over the joined transactions."""
    tiers = mart.segmented.where("known").agg(
        F.struct(
            *[F.count_if(F.col("segment") == tier).alias(column) for tier, column in TIER_COLUMNS.items()]
        ).alias("tiers")
    )
    totals = rolled_up(mart.profiles.where("known"), customers=F.count("*")).withColumn("tiers", tiers.scalar())
    return totals.select(
        F.col("customers").alias("total_customers"),
        F.coalesce("orders", F.lit(0)).alias("total_transactions"),
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
        return_rate().alias("return_rate_pct"),
        "tiers.*",
    )


def segmented_profiles(mart: Mart) -> DataFrame:
    """Segments with the attributes of their customers, in report types."""
    return mart.segmented.where("known").withColumns(
        {name: F.col(name).cast("bigint") for name in ("recency", "R_score", "F_score", "M_score", "RFM_score")}
    )


def vw_rfm_segments(mart: Mart) -> DataFrame:
    return segmented_profiles(mart).select(
        "customer_id",
        "segment",
        "age_group",
        "city",
        "gender",
        "recency",
        "frequency",
        money(F.col("monetary")).alias("monetary"),
        "R_score",
        "F_score",
        "M_score",
        "RFM_score",
    )


def vw_segment_summary(mart: Mart) -> DataFrame:
    return segment_profile(mart)


def vw_category_performance(mart: Mart) -> DataFrame:
    return mart.ranked_categories.select(
        "category",
        F.col("orders").alias("total_orders"),
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
        return_rate().alias("return_rate_pct"),
        F.col("rank").alias("revenue_rank"),
    )


def vw_monthly_trend(mart: Mart) -> DataFrame:
    months = monthly_totals(mart.facts, day=F.min("transaction_date"))
    return months.select(
        "month",
        F.year("day").cast("bigint").alias("year"),
        F.month("day").cast("bigint").alias("month_num"),
        month_name(F.col("day")).alias("month_name"),
        F.col("orders").alias("total_orders"),
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
        F.col("returned").alias("returns"),
    ).orderBy(F.asc_nulls_first("month"))


def vw_city_performance(mart: Mart) -> DataFrame:
    totals = customer_attribute_totals(mart, "city", customers=F.count("*"))
    return totals.select(
        "city",
        "customers",
        "orders",
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
    ).orderBy(F.desc("total_revenue"), "city")


def vw_segment_x_category(mart: Mart) -> DataFrame:
    return (
        segment_category_totals(mart)
        .select(
            "segment", "category", "orders", money(F.col("revenue")).alias("revenue"),
            average_order().alias("avg_order_value"),
        )
        .orderBy("segment", F.desc("revenue"), "category")
    )


def high_value(mart: Mart, spend: str) -> DataFrame:
    best = segmented_profiles(mart).where(F.col("segment").isin(HIGH_VALUE_TIERS))
    return best.orderBy(F.desc("monetary"), "customer_id").select(
        "customer_id",
        "segment",
        "age_group",
        "city",
        "gender",
        "recency",
        "frequency",
        money(F.col("monetary")).alias(spend),
        "RFM_score",
    )


def vw_high_value_customers(mart: Mart) -> DataFrame:
    return high_value(mart, "lifetime_value")


VIEWS = [
    vw_kpi_summary,
    vw_rfm_segments,
    vw_segment_summary,
    vw_category_performance,
    vw_monthly_trend,
    vw_city_performance,
    vw_segment_x_category,
    vw_high_value_customers,
]


def register_views(mart: Mart) -> list[str]:
    """Make the base tables and all report views available to ``spark.sql``."""
    tables = {
        "customers": mart.customers,
        "transactions": mart.transactions,
        "rfm_segments": mart.rfm_segments,
        **{view.__name__: view(mart) for view in VIEWS},
    }
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return list(tables)


def run_sql(mart: Mart, text: str, **parameters) -> DataFrame:
    """A SQL text with named parameters over the registered tables and views."""
    return mart.spark.sql(text, args=parameters or None)
