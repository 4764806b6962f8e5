"""Exact-size sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that one counting pass tells apart.
BITS = 16


def draw_share(table: DataFrame, key: str, share: float) -> DataFrame:
    """``floor(rows * share)`` rows without replacement, by the order of the MD5 of their key; null keys come first.

    The table is neither sorted nor written. Two passes count rows per slice of the hash's first bits, then per slice of
    that slice, which finds the cut to one part in four billion. Rows below it are drawn by a filter; only those within the
    last slice are put in order.
    """
    hashed = table.withColumn("_md5", F.md5(F.col(key).cast("string")))
    digits = F.conv(F.substring("_md5", 1, 2 * BITS // 4), 16, 10).cast("bigint")
    hashed = hashed.withColumn("_at", F.coalesce(digits, F.lit(-1)))
    left, low, width = None, -1, 1 << BITS
    for step in (1 << BITS, 1):
        inside = hashed if left is None else hashed.where(F.col("_at").between(low, low + width - 1))
        slices = inside.groupBy(F.floor(F.col("_at") / F.lit(step)).alias("slice")).agg(F.count("*").alias("n")).collect()
        if left is None:
            left = int(sum(row["n"] for row in slices) * share)
        low, n = None, 0
        for row in sorted(slices, key=lambda row: row["slice"]):
            low, n = row["slice"] * step, row["n"]
            if left < n:
                break
            left -= n
        else:
            return hashed.drop("_md5", "_at")  # all rows, or none if there are none
        width = step
    drawn = hashed.where(F.col("_at") < low)
    last = hashed.where(F.col("_at") == low).orderBy(F.asc_nulls_first("_md5"), key).limit(left)
    return drawn.unionByName(last).drop("_md5", "_at")
