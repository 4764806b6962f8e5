"""Small reshaping helpers for report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def label_table(spark: SparkSession, labels: Sequence[str], name: str) -> DataFrame:
    """An ordered label domain as rows ``(ord, name)``."""
    domain = F.array(*[F.lit(label) for label in labels])
    return spark.range(1).select(F.posexplode(domain).alias("ord", name))


def in_label_order(table: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One row per label in the given order; labels without data get nulls."""
    known = table.where(F.col(key).isin(list(labels)))
    domain = label_table(table.sparkSession, labels, key)
    # ``known`` is already grouped by the key, so it holds at most one row per label.
    return domain.join(F.broadcast(known), key, "left").orderBy("ord").drop("ord")


def over_all(aggregate: Column) -> Column:
    """An aggregate over every row of an already grouped (small) table."""
    return aggregate.over(Window.partitionBy())


def unpivot(table: DataFrame, name: str, value: str) -> DataFrame:
    """The columns of a table as (name, value) rows."""
    return table.unpivot([], [F.col(f"`{column}`") for column in table.columns], name, value)
