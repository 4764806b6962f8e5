"""Day and month helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_day(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_name(day: Column) -> Column:
    """Full month name; the built-in ``monthname`` abbreviates."""
    return F.date_format(day, "MMMM")


def month_spine(days: DataFrame, day: str) -> DataFrame:
    """Every month between the first and the last value of ``day``, gaps included."""
    return days.agg(
        F.explode(
            F.sequence(
                F.trunc(F.min(day), "month"),
                F.trunc(F.max(day), "month"),
                F.expr("interval 1 month"),
            )
        ).alias("month_start")
    ).select(month_key(F.col("month_start")).alias("month"))
