"""Equi-join of a large table with another, safe for keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.operators.sizing import fits_broadcast, shuffle_partitions

HANDS = 4

#: A key with more than one row in so many is frequent; fewer keys than this are, and their totals go to all tasks.
MOST_FREQUENT = 1 << 16

#: Slices of the keys' hash that are counted before any key is, so many for each partition and at least ``MOST_FREQUENT``.
SLICES = 16


def frequent_keys(table: DataFrame, key: str, partitions: int) -> DataFrame | None:
    """(key, hands) of every key that holds more than its share of ``partitions`` tasks: fewer keys than partitions.

    Slices of the keys' hash are counted first, which shuffles a few numbers per task: a slice with too few rows has no
    frequent key. Only in the other slices are rows counted key by key, exactly. ``hands`` is ``HANDS`` times the number of
    tasks that a key's rows fill, so that hands that meet in a task by chance stay small.
    """
    slice_ = F.pmod(F.xxhash64(key), F.lit(max(MOST_FREQUENT, SLICES * partitions))).cast("int")
    slices = table.groupBy(F.when(F.col(key).isNotNull(), slice_).alias("_slice")).agg(F.count("*").alias("_n"))
    slices = slices.agg(
        F.sum("_n").alias("rows"), F.sort_array(F.collect_list(F.struct("_n", "_slice")), False).alias("all")
    ).select("rows", F.filter("all", lambda one: (one["_n"] * partitions > F.col("rows")) & one["_slice"].isNotNull())["_slice"].alias("full"))
    rows, full = slices.first()
    if not full:
        return None
    counts = table.where(slice_.isin(full) & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    held = counts.where(F.col("_n") * partitions > F.lit(rows))
    hands = F.least(F.lit(HANDS * partitions), F.ceil(HANDS * F.col("_n") * partitions / F.lit(rows)))
    found = [(row[0], row[1]) for row in held.select(key, hands.cast("int")).collect()]
    kind = f"{key} {table.schema[key].dataType.simpleString()}, _hands int"
    return table.sparkSession.createDataFrame(found, kind) if found else None


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], count: str, most: int = MOST_FREQUENT) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row per key and in ``count`` how many rows hold it.

    Rows of frequent keys stay where they are and meet their totals there; the other keys hold too few rows to fill a
    task, so one key may hold any share of all rows. Null is a key like any other. Both tables are read twice, so they
    should be written ones or cheap. Columns of ``totals`` but the keys and the count are added; rows of a key without
    totals are left out.
    """
    everything = totals.agg(F.sum(count)).first()[0] or 0
    bound = everything // most
    added = [name for name in totals.columns if name not in (*keys, count)]
    same = {key: f"_same_{place}" for place, key in enumerate(keys)}
    keyed = totals.withColumnsRenamed(same)
    meet = reduce(lambda one, other: one & other, [F.col(key).eqNullSafe(F.col(name)) for key, name in same.items()])
    frequent = keyed.where(F.col(count) > bound).select(*same.values(), *added, F.lit(True).alias("_found"))
    # fewer than ``most`` rows: each of their keys holds more than one row in ``most``
    joined = rows.join(F.broadcast(frequent), meet, "left").drop(*same.values())
    common = joined.where("_found").drop("_found")
    if not bound:  # no key is rare
        return common
    rare = keyed.where(F.col(count) <= bound).select(*same.values(), *added)
    rest = joined.where(F.col("_found").isNull()).drop("_found", *added).join(rare, meet).drop(*same.values())
    return common.unionByName(rest)


def spread_join(
    big: DataFrame,
    other: DataFrame,
    key: str,
    row_number: str,
    how: str = "inner",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` with ``other`` on ``key``, splitting the rows of frequent keys over many tasks.

    A side that fits the broadcast limit goes to Catalyst unchanged. Otherwise the rows of a key that would
    fill more than one shuffle partition are dealt out by ``row_number`` (a column fixed when the file was
    scanned, so that a rerun task deals them the same way) over as many hands as it has shares, and the matching
    rows of ``other`` are repeated once per hand. The shares add up to one, so the copies stay few however large
    the tables are. Rows of a left join without a key match nothing and are dealt over all tasks. Frequent keys
    are looked for in ``keys_from``, the scan behind ``big``, if ``big`` is itself a join.
    """
    if how not in ("inner", "left"):
        raise ValueError("spread_join supports inner and left joins")
    if fits_broadcast(other):
        return big.join(other, key, how)
    partitions = shuffle_partitions(big.sparkSession)
    frequent = frequent_keys(big if keys_from is None else keys_from, key, partitions)
    turn = F.xxhash64(row_number)
    if frequent is None:
        hand, every_hand = F.lit(0), F.array(F.lit(0))
    else:
        # fewer keys than partitions
        big, other = (side.join(F.broadcast(frequent), key, "left") for side in (big, other))
        hand = F.coalesce(F.pmod(turn, F.col("_hands")).cast("int"), F.lit(0))
        every_hand = F.sequence(F.lit(0), F.coalesce("_hands", F.lit(1)) - 1)
    hand = F.when(F.col(key).isNull(), F.pmod(turn, F.lit(16 * partitions)).cast("int")).otherwise(hand)
    dealt = big.withColumn("_hand", hand).drop("_hands")
    copies = other.withColumn("_hand", F.explode(every_hand)).drop("_hands")
    return dealt.join(copies, [key, "_hand"], how).drop("_hand")
