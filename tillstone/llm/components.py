"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm.skew import with_totals
from tillstone.operators.storage import WorkTables


def contracted(links: DataFrame, tables: WorkTables, most_steps: int | None = None) -> DataFrame:
    """Links (u, v), u > v, that connect the same nodes as ``links`` (two columns of node numbers), drawn in to stars.

    Each step points the neighbours of every node at the smallest of them, first the larger neighbours, then the
    others, until nothing changes or ``most_steps`` are done; their number grows with the logarithm of the longest path.
    No adjacency list is collected: minima are aggregated before the shuffle, and those of nodes with many neighbours
    are sent to the rows, so that the hub of a large component costs no task more than others.
    """
    one, other = links.columns
    pairs = links.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).filter("u > v").distinct()
    pairs = tables.replace(pairs, "stars")
    before, step = None, 0
    while step != most_steps:
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        near = with_totals(both, tables.replace(least, "least"), "u", "n")
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.replace(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_totals(large, tables.replace(least, "least"), "u", "n")
        pairs = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select("v", "m")).distinct()
        pairs = tables.replace(pairs, "stars")
        step += 1
        if most_steps is None:
            now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
            if now == before:
                break
            before = now
    tables.discard("least", "large")
    return pairs


def labelled(pairs: DataFrame) -> DataFrame:
    """(node, label) of every node of contracted links: a connected node, and the smallest one if nothing was left to do."""
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select("v", "v").distinct())
    return ends.groupBy("node").agg(F.min("label").alias("label"))


def components(links: DataFrame, tables: WorkTables) -> DataFrame:
    """(node, label) of every node of ``links``; label: the smallest node it reaches."""
    return labelled(contracted(links, tables))
