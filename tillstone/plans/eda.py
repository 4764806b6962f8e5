"""Exploration of transactions: revenue by attribute, order values, discounts.

Groups without a label are left out here, as in a dataframe group-by; the SQL reports keep them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstone.functions.numbers import half_up, millions, money, percent, sum_cents
from tillstone.functions.shapes import in_label_order
from tillstone.operators.histogram import equal_width
from tillstone.operators.quantiles import exact_quantiles
from tillstone.plans.mart import Mart
from tillstone.plans.measures import average_order, monthly_totals, return_rate, rolled_up, totals_by

#: Discounts that have a column of their own: whole percents.
DISCOUNTS = range(101)


def eda_summary(mart: Mart) -> DataFrame:
    customers = mart.customers.agg(F.count("*")).scalar()
    return rolled_up(mart.customer_totals).select(
        customers.alias("customers"),
        F.col("rows").alias("transactions"),
        money(F.col("revenue")).alias("revenue"),
        average_order().alias("avg_order_value"),
        return_rate(1).alias("return_rate_pct"),
    )


def _labelled(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col(key).isNotNull())


def _revenue(totals: DataFrame, key: str) -> DataFrame:
    return totals.select(
        key, money(F.col("revenue")).alias("revenue"), millions(F.col("revenue")).alias("revenue_millions")
    )


def revenue_by_category(mart: Mart) -> DataFrame:
    totals = totals_by(_labelled(mart.facts, "category"), "category")
    return _revenue(totals, "category").orderBy(F.desc("revenue"), "category")


def top5_categories(mart: Mart) -> DataFrame:
    return revenue_by_category(mart).select("category", "revenue").orderBy(F.desc("revenue"), "category").limit(5)


def customer_attribute_totals(mart: Mart, *attributes: str, **extra) -> DataFrame:
    """Measures per customer attribute, from one row per customer."""
    return rolled_up(mart.buyers, *attributes, **extra)


def revenue_by_age_group(mart: Mart) -> DataFrame:
    totals = customer_attribute_totals(mart, "age_group")
    return in_label_order(_revenue(totals, "age_group"), "age_group", mart.age_bands)


def revenue_by_city(mart: Mart) -> DataFrame:
    totals = _labelled(customer_attribute_totals(mart, "city"), "city")
    return _revenue(totals, "city").orderBy("revenue", "city")


def revenue_by_gender(mart: Mart) -> DataFrame:
    totals = _labelled(customer_attribute_totals(mart, "gender"), "gender")
    return totals.select("gender", money(F.col("revenue")).alias("revenue")).orderBy("gender")


def payment_mode_distribution(mart: Mart) -> DataFrame:
    counts = _labelled(mart.facts, "payment_mode").groupBy("payment_mode").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    return counts.select("payment_mode", "n", percent(F.col("n"), everything, 1).alias("pct")).orderBy(
        F.desc("n"), "payment_mode"
    )


def monthly_revenue(mart: Mart) -> DataFrame:
    # dropping rows without a date, not groups without a month, keeps month texts out of the scan filter
    return _revenue(monthly_totals(_labelled(mart.facts, "transaction_date")), "month").orderBy("month")


def order_value_histogram(mart: Mart) -> DataFrame:
    amount = F.col("cents") / F.lit(100.0)
    return equal_width(mart.facts.select(amount.alias("amount")), "amount", 50)


def order_value_center(mart: Mart) -> DataFrame:
    cut = exact_quantiles(mart.facts, "cents", [Fraction(1, 2)])
    median = float(cut[()][0].value / 100) if cut else None
    return mart.facts.agg(
        half_up(sum_cents(F.col("cents")), F.count("cents")).alias("mean_value"),
        F.round(F.lit(median).cast("double"), 4).alias("median_value"),
    )


def category_discount_means(mart: Mart) -> DataFrame:
    """Mean order value per category and discount, one row each."""
    cells = _labelled(mart.facts, "discount_pct").where(F.col("cents").isNotNull())
    cells = totals_by(_labelled(cells, "category"), "category", "discount_pct")
    return cells.select("category", "discount_pct", average_order().alias("mean_value"))


def category_discount_pivot(mart: Mart) -> DataFrame:
    """Mean order value per category and discount: a column ``d<percent>`` for every whole percent, whatever the data.

    Discounts outside 0 to 100 are not lost: ``other`` holds theirs as JSON, ``{"<discount>": mean}`` by rising discount, and is
    null where there are none. The columns are known before a row is read.
    """
    discount, mean = F.col("discount_pct"), F.col("mean_value")
    inside = discount.between(DISCOUNTS[0], DISCOUNTS[-1])
    others = F.sort_array(F.collect_list(F.when(~inside, F.struct(discount.cast("bigint").alias("key"), mean.alias("value")))))
    wide = category_discount_means(mart).groupBy("category").agg(
        *[F.max(F.when(discount == percent, mean)).alias(f"d{percent}") for percent in DISCOUNTS], others.alias("_others")
    )
    named = F.transform("_others", lambda cell: F.struct(cell["key"].cast("string").alias("key"), cell["value"].alias("value")))
    other = F.when(F.size("_others") > 0, F.to_json(F.map_from_entries(named)))
    return wide.withColumn("other", other).drop("_others").orderBy("category")
