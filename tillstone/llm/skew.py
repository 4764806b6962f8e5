"""Joins of rows with a table of totals per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is frequent; fewer keys than this are, and their totals go to all tasks.
MOST_FREQUENT = 1 << 16


def with_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, most: int = MOST_FREQUENT, *, shuffled: bool = False) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row per key and in ``count`` how many rows hold it.

    Rows of frequent keys stay where they are and meet their totals there; the other keys hold too few rows to fill a
    task. Null is a key like any other. Both tables are read twice, so they should be written ones or cheap. Columns of
    ``totals`` but the key and the count are added; rows of a key without totals are left out. If ``shuffled``, the
    totals of other keys grow with the data and are never sent to all tasks, however small they seem.
    """
    everything = totals.agg(F.sum(count)).first()[0] or 0
    bound = everything // most
    added = [name for name in totals.columns if name not in (key, count)]
    same, found = f"{key}_same", f"{key}_found"
    keyed = totals.withColumnRenamed(key, same)
    frequent = keyed.filter(F.col(count) > bound).select(same, *added, F.lit(True).alias(found))
    # fewer than ``most`` rows: each of their keys holds more than one row in ``most``
    joined = rows.join(F.broadcast(frequent), F.col(key).eqNullSafe(F.col(same)), "left").drop(same)
    if not bound:  # no key is rare
        return joined.filter(found).drop(found)
    rest = joined.filter(F.col(found).isNull()).drop(found, *added)
    rare = keyed.filter(F.col(count) <= bound).select(same, *added)
    rest = rest.join(rare.hint("merge") if shuffled else rare, F.col(key).eqNullSafe(F.col(same))).drop(same)
    return joined.filter(found).drop(found).unionByName(rest)
