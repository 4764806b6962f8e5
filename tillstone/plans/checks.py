"""Data-quality reports and stand-ins for the data generator's sampling steps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.functions.dates import month_spine
from tillstone.functions import numbers
from tillstone.functions.numbers import money, percent
from tillstone.functions.text import hash_bucket, weighted_label
from tillstone.operators import quality
from tillstone.operators.sampling import draw_share
from tillstone.plans.mart import Mart
from tillstone.plans.measures import average_order, monthly_totals, return_rate, totals_by
from tillstone.schemas import CUSTOMERS, TEXT_LIMITS
from tillstone.sources.files import write_bundle

# Shares of best customers that the skew report lists, in percent.
TOP_SHARES = [1, 5, 10, 20, 50]

#: Arms of a campaign and the shares of customers that are dealt to them, unless a caller has others.
ARMS = {"no contact": 0.5, "letter": 0.3, "call": 0.2}

HIGH_VALUE_SHARE = 0.2
AMOUNT_LIMIT = 10**10


def pk_check(mart: Mart) -> DataFrame:
    checks = [
        quality.pk_check(mart.customers, ["customer_id"], "customers"),
        quality.pk_check(mart.transactions, ["transaction_id"], "transactions"),
        quality.pk_check(mart.rfm_segments, ["customer_id"], "rfm_segments"),
    ]
    return reduce(DataFrame.unionAll, checks)


def fk_check(mart: Mart) -> DataFrame:
    bought = mart.customer_totals.select("customer_id", "rows")
    scored = mart.rfm_segments.select("customer_id", F.lit(1).cast("bigint").alias("rows"))
    return quality.fk_check(bought, mart.customers, "customer_id", "transactions", "customers").unionAll(
        quality.fk_check(scored, mart.customers, "customer_id", "rfm_segments", "customers")
    )


def domain_check(mart: Mart) -> DataFrame:
    def too_long(table: str):
        return {
            f"{column}_length": F.length(F.col(column).cast("string")) > limit
            for column, limit in TEXT_LIMITS[table].items()
        }

    transactions = {
        **too_long("transactions"),
        "returned_flag": ~F.col("returned").isin(0, 1),
        "discount_range": ~F.col("discount_pct").between(0, 100),
        "quantity_positive": F.col("quantity") < 1,
        "amount_precision": (F.abs("product_amount") >= AMOUNT_LIMIT) | (F.abs("final_amount") >= AMOUNT_LIMIT),
        "amount_sign": F.col("final_amount") < 0,
    }
    return quality.domain_check(mart.customers, too_long("customers"), "customers").unionAll(
        quality.domain_check(mart.transactions, transactions, "transactions")
    )


def column_profile(mart: Mart) -> DataFrame:
    return quality.column_profile(mart.transactions)


def sample_customers(mart: Mart) -> DataFrame:
    """The fifth of the customers that a draw without replacement marks as high value."""
    return draw_share(mart.customers.select("customer_id"), "customer_id", HIGH_VALUE_SHARE)


def date_spine_revenue(mart: Mart) -> DataFrame:
    """Revenue for every month of the span, zero where nothing was sold."""
    months = monthly_totals(mart.facts).select("month", F.col("revenue"))
    return (
        month_spine(mart.customer_totals.select(F.explode(F.array("first_date", "last_date")).alias("day")), "day")
        .join(months, "month", "left")
        .select("month", F.coalesce(money(F.col("revenue")), F.lit(0.0)).alias("revenue"))
        .orderBy("month")
    )


def weighted_bucket(mart: Mart, arms: Mapping[str, float] = ARMS) -> DataFrame:
    """Every customer's arm of a campaign, by a hash of the id: the same at each call, whatever customers come or go."""
    bucket = hash_bucket(F.col("customer_id"))
    return mart.customers.select("customer_id", bucket.alias("bucket"), weighted_label(bucket, arms).alias("arm"))


def csv_round_trip(mart: Mart) -> DataFrame:
    """Sales by category from the mart's own tables written as CSV and read again, with the number of lines that did not fit."""
    folder = f"{mart.store.folder}/round-trip"
    people = mart.customers.select(
        *[
            F.col(field.name) if field.name in mart.customers.columns else F.lit(None).cast(field.dataType).alias(field.name)
            for field in CUSTOMERS
        ]
    )
    write_bundle({"customers.csv": people, "transactions.csv": mart.transactions}, folder, "csv")
    again = type(mart).from_csv(mart.spark, folder, on_bad_rows="quarantine", clustering_method=mart.clustering_method)
    rejected = again.rejected.agg(F.count("*")).scalar()
    return totals_by(again.facts, "category").select(
        "category",
        F.col("rows").alias("total_orders"),
        money(F.col("revenue")).alias("total_revenue"),
        average_order().alias("avg_order_value"),
        return_rate().alias("return_rate_pct"),
        rejected.alias("rejected"),
    )


def skew_report(mart: Mart) -> DataFrame:
    """Orders and revenue held by the best customers, all shares in one pass."""
    placed = mart.spend_positions
    inside = {
        top: F.col("position") <= F.call_function("div", F.col("row_count") * top + 99, F.lit(100))
        for top in TOP_SHARES
    }
    sums = [
        F.struct(
            F.lit(top).cast("bigint").alias("top_pct"),
            F.count_if(held).alias("customers"),
            F.coalesce(F.sum(F.when(held, F.col("orders"))), F.lit(0)).alias("orders"),
            F.sum(F.when(held, F.col("revenue"))).alias("spend"),
        )
        for top, held in inside.items()
    ]
    table = placed.agg(
        F.array(*sums).alias("tops"), F.sum("orders").alias("all_orders"), F.sum("revenue").alias("all_spend")
    )
    return table.select("all_orders", "all_spend", F.inline("tops")).select(
        "top_pct",
        "customers",
        "orders",
        money(F.col("spend")).alias("revenue"),
        percent(F.col("orders"), F.col("all_orders")).alias("orders_pct"),
        percent(F.col("spend"), F.col("all_spend")).alias("revenue_pct"),
    )


def net_amount(mart: Mart) -> DataFrame:
    due = numbers.net_amount(F.col("product_amount"), F.col("quantity"), F.col("discount_pct"))
    return mart.transactions.select("transaction_id", due.cast("double").alias("net_amount"))
