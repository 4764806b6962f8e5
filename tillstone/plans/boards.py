"""Tables behind the dashboard and the BI bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.functions.dates import day_text
from tillstone.functions.numbers import half_up, millions, money, percent, thousands
from tillstone.functions.shapes import in_label_order, over_all, unpivot
from tillstone.plans.eda import customer_attribute_totals
from tillstone.plans.mart import Mart
from tillstone.plans.measures import average_order, monthly_totals, return_rate, rolled_up, totals_by
from tillstone.plans.rfm import segment_totals
from tillstone.plans.sales import segment_category_totals, segment_contribution
from tillstone.plans.views import TIER_COLUMNS, high_value
from tillstone.schemas import TIERS


def dash_kpis(mart: Mart) -> DataFrame:
    """Customers with transactions, their spend, and the mean order value of all transactions."""
    mean_order = rolled_up(mart.customer_totals).select(average_order()).scalar()
    # customer ids are unique in the segments, so rows are customers
    return mart.rfm_segments.agg(F.count("customer_id").alias("customers"), F.sum("monetary").alias("spend")).select(
        F.col("customers").alias("total_customers"),
        money(F.col("spend")).alias("total_revenue"),
        millions(F.col("spend")).alias("total_revenue_millions"),
        mean_order.alias("avg_order_value"),
    )


def dash_segment_revenue(mart: Mart) -> DataFrame:
    shares = segment_totals(mart).select(
        "segment",
        money(F.col("spend")).alias("revenue"),
        millions(F.col("spend")).alias("revenue_millions"),
        percent(F.col("spend"), over_all(F.sum("spend")), 1).alias("pct"),
    )
    return in_label_order(shares, "segment", TIERS)


def dash_segment_count(mart: Mart) -> DataFrame:
    pct = percent(F.col("n"), over_all(F.sum("n")), 0).alias("pct")
    return in_label_order(segment_totals(mart).select("segment", "n", pct), "segment", TIERS)


def dash_segment_avg(mart: Mart) -> DataFrame:
    means = segment_totals(mart).select(
        "segment",
        half_up(F.col("spend"), F.col("n")).alias("avg_monetary"),
        F.round(thousands(F.col("spend")) / F.col("n"), 1).alias("avg_monetary_thousands"),
    )
    return in_label_order(means, "segment", TIERS)


def bi_kpi_long(mart: Mart) -> DataFrame:
    """Nine KPIs as (KPI, Value) rows; the tier counts come from one pass over the segments."""
    customers = mart.customers.agg(F.count("*")).scalar()
    tiers = mart.rfm_segments.agg(
        *[F.count_if(F.col("segment") == tier).alias(column) for tier, column in TIER_COLUMNS.items()]
    )
    totals = rolled_up(mart.customer_totals).select(
        customers.cast("double").alias("Total Customers"),
        F.col("rows").cast("double").alias("Total Transactions"),
        money(F.col("revenue")).alias("Total Revenue (Rs.)"),
        average_order().alias("Avg Order Value (Rs.)"),
        return_rate().alias("Return Rate (%)"),
    )
    counts = tiers.select(
        F.col("champions").cast("double").alias("Champions Count"),
        F.col("loyal_customers").cast("double").alias("Loyal Customers Count"),
        F.col("at_risk").cast("double").alias("At Risk Count"),
        F.col("lost_inactive").cast("double").alias("Lost/Inactive Count"),
    )
    return unpivot(totals, "KPI", "Value").unionAll(unpivot(counts, "KPI", "Value"))


def bi_by_category(mart: Mart) -> DataFrame:
    return (
        totals_by(mart.facts, "category")
        .select(
            "category",
            F.col("rows").alias("total_orders"),
            money(F.col("revenue")).alias("total_revenue"),
            average_order().alias("avg_order_value"),
            return_rate().alias("return_rate_pct"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def bi_by_city(mart: Mart) -> DataFrame:
    totals = customer_attribute_totals(mart, "city", customers=F.count("*"))
    return totals.select("city", "customers", "orders", money(F.col("revenue")).alias("total_revenue")).orderBy(
        F.desc("total_revenue"), "city"
    )


def bi_by_age_group(mart: Mart) -> DataFrame:
    totals = customer_attribute_totals(mart, "age_group", customers=F.count("*"))
    return totals.select(
        "age_group",
        "customers",
        average_order().alias("avg_order_value"),
        money(F.col("revenue")).alias("total_revenue"),
    ).orderBy(F.desc("total_revenue"), "age_group")


def bi_monthly_trend(mart: Mart) -> DataFrame:
    return (
        monthly_totals(mart.facts)
        .select(
            "month",
            F.col("rows").alias("orders"),
            money(F.col("revenue")).alias("revenue"),
            average_order().alias("avg_order_value"),
        )
        .orderBy(F.asc_nulls_first("month"))
    )


def bi_high_value_customers(mart: Mart) -> DataFrame:
    return high_value(mart, "monetary")


def bi_raw_customers(mart: Mart) -> DataFrame:
    return mart.customers


def bi_raw_transactions(mart: Mart) -> DataFrame:
    return mart.transactions.withColumns(
        {
            "transaction_date": day_text(F.col("transaction_date")),
            "product_amount": money(F.col("product_amount")),
            "final_amount": money(F.col("final_amount")),
            **{name: F.col(name).cast("bigint") for name in ("quantity", "discount_pct", "returned")},
        }
    )


def bi_raw_rfm(mart: Mart) -> DataFrame:
    wide = ("recency", "R_score", "F_score", "M_score", "RFM_score", "cluster")
    return mart.rfm_segments.withColumns(
        {**{name: F.col(name).cast("bigint") for name in wide}, "monetary": money(F.col("monetary"))}
    )


def bi_segment_by_category(mart: Mart) -> DataFrame:
    """Rows (with or without an id) and revenue per segment and category."""
    totals = segment_category_totals(mart)
    return totals.select("segment", "category", F.col("rows").alias("orders"), money(F.col("revenue")).alias("revenue")).orderBy(
        "segment", F.desc("revenue"), "category"
    )


# Table names of the BI bundle, in order.
BUNDLE = {
    "Customers": bi_raw_customers,
    "Transactions": bi_raw_transactions,
    "RFM_Segments": bi_raw_rfm,
    "KPI_Summary": bi_kpi_long,
    "By_Segment": segment_contribution,
    "By_Category": bi_by_category,
    "By_City": bi_by_city,
    "By_Age_Group": bi_by_age_group,
    "Monthly_Trend": bi_monthly_trend,
    "Segment_x_Category": bi_segment_by_category,
    "High_Value_Customers": bi_high_value_customers,
}


def bi_bundle(mart: Mart) -> dict[str, DataFrame]:
    return {name: build(mart) for name, build in BUNDLE.items()}
