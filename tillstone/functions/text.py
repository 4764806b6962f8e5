"""Identifiers, hashing and rendered widths."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 10_000


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``CUST0042``-style id. Numbers wider than ``width`` keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def hash_bucket(key: Column) -> Column:
    """Stable bucket 0..9999 of a key, from the first eight digits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % HASH_BUCKETS


def weighted_label(bucket: Column, weights: Mapping[str, float]) -> Column:
    """Label whose cumulative weight range holds the bucket; weights must add up to one."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    limits = [round(limit * HASH_BUCKETS) for limit in accumulate(weights.values())]
    labels = list(weights)
    choice = F.lit(labels[-1])
    for label, limit in reversed(list(zip(labels[:-1], limits[:-1]))):
        choice = F.when(bucket < limit, label).otherwise(choice)
    return choice
