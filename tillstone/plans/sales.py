"""Business questions on customers, cohorts, categories and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.functions.dates import month_key
from tillstone.functions.numbers import half_up, money, percent
from tillstone.functions.shapes import over_all
from tillstone.operators.ordering import tile, top_ranked
from tillstone.plans.mart import Mart
from tillstone.plans.measures import average_order, return_rate, rolled_up


def top20_customers(mart: Mart, k: int = 20) -> DataFrame:
    """Best customers by revenue with their rank and the running total over all customers."""
    ranked = top_ranked(mart.buyers, "revenue", "customer_id", k)
    return ranked.select(
        "customer_id",
        "age_group",
        "city",
        "orders",
        money(F.col("revenue")).alias("total_spent"),
        F.col("rank").alias("revenue_rank"),
        money(F.col("running_total")).alias("running_total"),
    ).orderBy("revenue_rank", "customer_id")


def segment_profile(mart: Mart) -> DataFrame:
    """Size, mean RFM and revenue share per segment."""
    grouped = mart.rfm_segments.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        half_up(F.sum("recency"), F.count("recency"), 1).alias("avg_recency_days"),
        half_up(F.sum("frequency"), F.count("frequency"), 1).alias("avg_orders"),
        half_up(F.sum("monetary"), F.count("monetary")).alias("avg_revenue"),
        F.sum("monetary").alias("spend"),
    )
    return grouped.withColumns(
        {
            "total_revenue": money(F.col("spend")),
            "revenue_pct": percent(F.col("spend"), over_all(F.sum("spend"))),
        }
    ).drop("spend")


def segment_contribution(mart: Mart) -> DataFrame:
    return segment_profile(mart).orderBy(F.desc("total_revenue"), "segment")


def cohort_revenue(mart: Mart) -> DataFrame:
    """Revenue by month of first purchase.

    The first purchase is part of the per-customer totals, so the transactions are neither read again
    nor joined to themselves.
    """
    buyers = mart.customer_totals.where(F.col("customer_id").isNotNull())
    cohorts = rolled_up(
        buyers.withColumn("cohort_month", month_key(F.col("first_date"))), "cohort_month", customers=F.count("*")
    )
    return cohorts.select(
        "cohort_month",
        "customers",
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
    ).orderBy(F.asc_nulls_first("cohort_month"))


def cohort_revenue_12(mart: Mart) -> DataFrame:
    return cohort_revenue(mart).orderBy(F.asc_nulls_first("cohort_month")).limit(12)


def category_cumulative(mart: Mart) -> DataFrame:
    """Categories by falling revenue with the cumulative share; equal revenues share rank and share."""
    return mart.ranked_categories.select(
        "category",
        F.col("orders").alias("total_orders"),
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
        F.col("rank").alias("revenue_rank"),
        percent(F.col("running"), F.col("running_whole")).alias("cumulative_pct"),
    ).orderBy("revenue_rank", "category")


def mom_growth(mart: Mart) -> DataFrame:
    """Revenue per month against the month before; null where there is none or it sold nothing."""
    return mart.month_steps.select(
        "month",
        money(F.col("revenue")).alias("revenue"),
        money(F.col("before")).alias("prev_month"),
        percent(F.col("revenue") - F.col("before"), F.col("before")).alias("mom_growth_pct"),
    ).orderBy(F.asc_nulls_first("month"))


def segment_category_totals(mart: Mart) -> DataFrame:
    segments = mart.rfm_segments.select("customer_id", "segment")
    return rolled_up(mart.category_totals.join(segments, "customer_id"), "segment", "category")


def segment_category_matrix(mart: Mart) -> DataFrame:
    return (
        segment_category_totals(mart)
        .select("segment", "category", "orders", money(F.col("revenue")).alias("total_revenue"))
        .orderBy("segment", F.desc("total_revenue"), "category")
    )


def return_rate_by_segment(mart: Mart) -> DataFrame:
    return rolled_up(mart.segmented, "segment").select(
        "segment",
        F.col("orders").alias("total_orders"),
        F.col("returned").alias("returned_orders"),
        return_rate().alias("return_rate_pct"),
    ).orderBy(F.desc("return_rate_pct"), "segment")


def segment_demographics_export(mart: Mart) -> DataFrame:
    keys = ["segment", "age_group", "city", "gender"]
    return (
        rolled_up(mart.segmented.where("known"), *keys)
        .select(
            *keys,
            F.col("orders").alias("total_orders"),
            money(F.col("revenue")).alias("total_revenue"),
            average_order().alias("avg_order_value"),
            return_rate().alias("return_rate_pct"),
        )
        .orderBy(F.desc("total_revenue"), *keys)
    )


def quintile_pareto(mart: Mart) -> DataFrame:
    """Revenue held by each fifth of the customers, best customers first."""
    placed = mart.spend_positions
    grouped = placed.groupBy(tile(F.col("position"), F.col("row_count"), 5).alias("quintile")).agg(
        F.count("*").alias("customers"), F.sum("revenue").alias("spend")
    )
    return grouped.select(
        "quintile",
        "customers",
        money(F.col("spend")).alias("revenue"),
        percent(F.col("spend"), over_all(F.sum("spend"))).alias("revenue_pct"),
    ).orderBy("quintile")
