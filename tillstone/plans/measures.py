"""Sales measures that can be added up, from transactions or from coarser totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.functions.dates import month_key
from tillstone.functions.numbers import half_up, percent, sum_cents

MEASURES = {
    "rows": lambda: F.count("*"),
    "orders": lambda: F.count("counted"),
    "amounts": lambda: F.count("cents"),
    "revenue": lambda: sum_cents(F.col("cents")),
    "flags": lambda: F.count("returned"),
    "returned": lambda: F.sum("returned"),
}


def totals_by(facts: DataFrame, *keys: str, **extra: Column) -> DataFrame:
    """Every measure per key, straight from the transactions; unused measures are pruned."""
    measures = [build().alias(name) for name, build in MEASURES.items()]
    return facts.groupBy(*keys).agg(*measures, *[column.alias(name) for name, column in extra.items()])


def rolled_up(totals: DataFrame, *keys: str, **extra: Column) -> DataFrame:
    """The measures of ``totals_by`` at a coarser key."""
    present = [name for name in MEASURES if name in totals.columns]
    measures = [F.sum(name).alias(name) for name in present]
    return totals.groupBy(*keys).agg(*measures, *[column.alias(name) for name, column in extra.items()])


def average_order(digits: int = 2) -> Column:
    return half_up(F.col("revenue"), F.col("amounts"), digits)


def return_rate(digits: int = 2) -> Column:
    return percent(F.col("returned"), F.col("flags"), digits)


def monthly_totals(facts: DataFrame, **extra: Column) -> DataFrame:
    """Measures per month. Days are totalled first, so the month text is built once per day, not per row."""
    by_day = totals_by(facts, "transaction_date")
    return rolled_up(by_day.withColumn("month", month_key(F.col("transaction_date"))), "month", **extra)
