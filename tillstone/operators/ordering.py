"""Positions, tiles and top-k over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.operators.storage import WorkTables

ROW_BITS = 33


def with_position(table: DataFrame, order: Sequence[Column], store: WorkTables, name: str) -> DataFrame:
    """Add the 1-based ``position`` of every row in a total order, and the ``row_count`` of the table.

    The table is range-sorted over all tasks and written, which freezes the (sorted part, row) pair that
    ``monotonically_increasing_id`` packs into one number. The sizes of the parts, one row each, then
    give the position of the first row of every part. ``order`` must end in a unique key: ties are
    spread over as many parts as they need.
    """
    ordered = table.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    frozen = store.save(ordered, name)
    part = F.shiftright("_row", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        frozen.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
            F.sum("_rows").over(Window.partitionBy()).alias("row_count"),
        )
    )
    row_in_part = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        frozen.withColumn("_part", part)
        # one row per sorted part: bounded by the number of shuffle partitions
        .join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + row_in_part + 1)
        .drop("_part", "_row", "_start")
    )


def _added(one: Column, other: Column) -> Column:
    """A sum that is null only if both parts are, as SUM over rows is."""
    return F.coalesce(one + other, one, other)


def with_running(
    table: DataFrame,
    value: str,
    tie: str,
    store: WorkTables,
    name: str,
    *,
    descending: bool = True,
    nulls_last: bool = True,
    running: Mapping[str, str] | None = None,
    lags: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``rank`` by ``value``, running totals and values of the row before, over a table of any number of rows.

    ``running`` maps a new column to the column it adds up from the first row to the last one of the same value, as the
    default RANGE frame does; the total over all rows is added as ``{new}_whole``. ``lags`` maps a new column to one whose
    value in the row before it takes. The order is that of ``value``, then ``tie``.

    Two passes: the table is range-sorted over all tasks and written in numbered parts. Then every part is added up, and
    its first and last value, which it may share with its neighbours, on their own; from these few rows per part come
    the part's offsets, and rank and totals of the values on its edges. Within a part plain windows do the rest. A value
    that very many rows share stays spread over as many parts as they need.
    """
    running, lags = dict(running or {}), dict(lags or {})
    columns = table.columns
    direction = {
        (True, True): F.desc_nulls_last, (True, False): F.desc_nulls_first,
        (False, True): F.asc_nulls_last, (False, False): F.asc_nulls_first,
    }[descending, nulls_last]
    frozen = store.save(table.orderBy(direction(value), tie).withColumn("_row", F.monotonically_increasing_id()), name)
    rows = frozen.withColumn("_part", F.shiftright("_row", ROW_BITS))

    totals = {f"_sum_{new}": F.sum(old) for new, old in running.items()}
    parts = rows.groupBy("_part").agg(
        F.count("*").alias("_rows"),
        F.min_by(value, "_row").alias("_first"),
        F.max_by(value, "_row").alias("_last"),
        *[F.max_by(old, "_row").alias(f"_tail_{new}") for new, old in lags.items()],
        *[total.alias(sum_) for sum_, total in totals.items()],
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {
            "_rows_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            **{f"_before_{new}": F.sum(f"_sum_{new}").over(before) for new in running},
            **{f"{new}_whole": F.sum(f"_sum_{new}").over(Window.partitionBy()) for new in running},
            **{f"_tail_{new}": F.lag(f"_tail_{new}").over(Window.orderBy("_part")) for new in lags},
        }
    )
    parts = store.save(parts, f"{name}-parts")  # a row per sorted part: as many as a shuffle has partitions

    # rows and sums of a part's first value, then of its last one if that is another
    edged = rows.join(F.broadcast(parts.select("_part", "_first", "_last")), "_part")
    is_first, is_last = (F.col(value).eqNullSafe(F.col(edge)) for edge in ("_first", "_last"))
    edges = edged.where(is_first | is_last).groupBy("_part", F.col(value).alias("_value")).agg(
        F.count("*").alias("_n"), *[total.alias(f"{sum_}_here") for sum_, total in totals.items()]
    )
    edges = edges.join(F.broadcast(parts), "_part")
    ends_part = F.col("_value").eqNullSafe(F.col("_last"))
    starts = {"_start": F.col("_rows_before") + F.when(ends_part, F.col("_rows") - F.col("_n")).otherwise(0)}
    for new in running:
        # what stands before the value within its part: all of the part but itself if it is the last one, else nothing
        within = F.when(ends_part & (F.col("_rows") > F.col("_n")), F.col(f"_sum_{new}") - F.coalesce(f"_sum_{new}_here", F.lit(0)))
        starts[f"_start_{new}"] = _added(F.col(f"_before_{new}"), within)
    values = edges.withColumns(starts).groupBy("_value").agg(
        (F.min("_start") + 1).alias("_rank"),
        *[
            _added(F.min_by(f"_start_{new}", "_start"), F.sum(f"_sum_{new}_here")).alias(f"_edge_{new}")
            for new in running
        ],
    )
    # at most two rows per part
    values = store.save(values, f"{name}-edges")

    local = Window.partitionBy("_part").orderBy(direction(value))
    peers = local.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.partitionBy("_part").orderBy("_row")
    measured = rows.withColumns(
        {
            "_local": F.rank().over(local),
            "_turn": F.row_number().over(in_order),
            **{f"_local_{new}": F.sum(old).over(peers) for new, old in running.items()},
            **{f"_lag_{new}": F.lag(old).over(in_order) for new, old in lags.items()},
        }
    )
    known = values.withColumn("_edge", F.lit(True))
    joined = measured.join(F.broadcast(parts), "_part").join(
        F.broadcast(known), F.col(value).eqNullSafe(F.col("_value")), "left"
    )
    edge = F.col("_edge").isNotNull()
    return joined.select(
        *columns,
        F.when(edge, F.col("_rank")).otherwise(F.col("_rows_before") + F.col("_local")).alias("rank"),
        *[
            F.when(edge, F.col(f"_edge_{new}")).otherwise(_added(F.col(f"_before_{new}"), F.col(f"_local_{new}"))).alias(new)
            for new in running
        ],
        *[f"{new}_whole" for new in running],
        *[F.when(F.col("_turn") == 1, F.col(f"_tail_{new}")).otherwise(F.col(f"_lag_{new}")).alias(new) for new in lags],
    )


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """Tile number 1..tiles of a position; the first tiles take the extra rows, as NTILE does."""
    size = F.call_function("div", rows, F.lit(tiles))
    extra = rows % tiles
    wide_rows = extra * (size + 1)
    in_wide = F.call_function("div", position - 1, size + 1) + 1
    in_narrow = extra + F.call_function("div", position - 1 - wide_rows, F.greatest(size, F.lit(1))) + 1
    return F.when(position <= wide_rows, in_wide).otherwise(in_narrow)


def top_ranked(table: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """First ``k`` rows by falling ``value`` with their rank and running total over the whole table.

    Rank and running total of a row depend only on rows with a value at least as large. So the value of
    row ``k`` is found first; the rows at or above it have at most ``k`` distinct values, and only those
    values (with their row counts) are ranked. Ties share rank and running total, and a value shared by
    any number of rows stays one row. Rows without a value share the last rank.
    """
    first = table.select(value, tie).orderBy(F.desc_nulls_last(value), tie).limit(k)
    least, nulls = first.agg(F.min(value), F.count_if(F.col(value).isNull())).first()
    reached = table.where(F.col(value) >= F.lit(least)) if least is not None else table.where(F.lit(False))
    if nulls:
        # all other rows come first; they are fewer than ``k``
        reached = table
    so_far = Window.orderBy(F.desc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        reached.groupBy(value)
        .agg(F.count("*").alias("_rows"))
        .select(
            F.col(value).alias("_value"),
            (F.sum("_rows").over(so_far) - F.col("_rows") + 1).alias("rank"),
            F.sum(F.col(value) * F.col("_rows").cast("decimal(16,0)")).over(so_far).alias("running_total"),
        )
    )
    head = reached.orderBy(F.desc_nulls_last(value), tie).limit(k)
    return head.join(F.broadcast(ranked), F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
