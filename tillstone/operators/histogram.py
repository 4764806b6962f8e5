"""Equal-width histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_width(table: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts per bin over the full range; every bin is listed and the last one is closed on the right.

    A constant column is spread over a range of width one centred on its value.
    """
    x = F.col("_x")
    rows = table.select(F.col(value).cast("double").alias("_x")).where(x.isNotNull())
    limits = rows.agg(F.min(x).alias("least"), F.max(x).alias("most")).first()
    if limits["least"] is None:
        return table.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    least, most = limits
    if least == most:
        least, most = least - 0.5, most + 0.5
    width = (most - least) / bins
    index = F.least(F.floor((x - F.lit(least)) / F.lit(width)), F.lit(bins - 1))
    counts = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    domain = table.sparkSession.range(bins).withColumnRenamed("id", "bin")
    edge = F.lit(least) + F.col("bin") * F.lit(width)
    return (
        # at most one row per bin
        domain.join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            F.round(edge, 4).alias("lo"),
            F.round(F.lit(least) + (F.col("bin") + 1) * F.lit(width), 4).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )
