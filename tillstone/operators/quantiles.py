"""Exact order statistics: of a few groups by repeated narrowing, of any number of groups by their places in one sort."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstone.operators.joins import join_totals
from tillstone.operators.ordering import with_position
from tillstone.operators.storage import WorkTables

SLICE_BUDGET = 1 << 16


@dataclass(frozen=True)
class Quantile:
    """The two neighbours of a quantile in sorted order and the fraction of the way between them."""

    lower: Decimal
    upper: Decimal
    fraction: Fraction

    @property
    def value(self) -> Fraction:
        return Fraction(self.lower) + self.fraction * (Fraction(self.upper) - Fraction(self.lower))


def group_quantiles(
    table: DataFrame, value: str, probabilities: Sequence[Fraction], by: Sequence[str], store: WorkTables, name: str
) -> DataFrame:
    """Linear-interpolation quantiles of any number of groups, as a table.

    One row per group and probability: ``by``, ``place`` (which probability), ``rows`` of the group, ``lower`` and ``upper``,
    the two neighbours of the quantile in sorted order, and the way between them as a fraction ``part / whole``.

    All rows are sorted by group and value over all tasks at once, so that a group of any size, or a value that very many
    rows share, is spread over as many tasks as it needs. A group's rows then stand at known positions of the whole order;
    the wanted positions, a few per group, are looked up by number. Nothing per group reaches the driver.
    """
    by = list(by)
    rows = table.where(F.col(value).isNotNull()).select(*by, value, F.monotonically_increasing_id().alias("_tie"))
    placed = with_position(rows, [*by, value, "_tie"], store, name)
    groups = placed.groupBy(*by).agg(F.min("position").alias("_start"), F.count("*").alias("rows"))
    wanted = []
    for place, probability in enumerate(map(Fraction, probabilities)):
        steps = (F.col("rows") - 1) * probability.numerator
        whole = F.lit(probability.denominator).cast("bigint")
        lower = F.call_function("div", steps, whole)
        upper = F.call_function("div", steps + whole - 1, whole)
        for side, rank in (("lower", lower), ("upper", upper)):
            wanted.append(
                F.struct(
                    F.lit(place).alias("place"), F.lit(side).alias("_side"), (F.col("_start") + rank).alias("position"),
                    (steps % whole).alias("part"), whole.alias("whole"),
                )
            )
    places = groups.select(*by, "rows", F.inline(F.array(*wanted)))
    found = places.join(placed.select("position", F.col(value).alias("_value")), "position")
    sides = [F.max(F.when(F.col("_side") == side, F.col("_value"))).alias(side) for side in ("lower", "upper")]
    return found.groupBy(*by, "rows", "place", "part", "whole").agg(*sides)


def interpolated(lower: Column, upper: Column, part: Column, whole: Column) -> Column:
    """The quantile between its neighbours, as a double."""
    low, high = lower.cast("double"), upper.cast("double")
    return low + (high - low) * part.cast("double") / whole.cast("double")


def box_stats(table: DataFrame, value: str, by: Sequence[str], store: WorkTables, name: str) -> DataFrame:
    """Box-plot numbers of any number of groups: extremes, quartiles, whiskers within 1.5 IQR, rows beyond them."""
    by, names = list(by), ["least", "q1", "med", "q3", "most"]
    cuts = group_quantiles(table, value, [Fraction(k, 4) for k in range(5)], by, store, f"{name}-sorted")
    quantile = interpolated(F.col("lower"), F.col("upper"), F.col("part"), F.col("whole"))
    summary = cuts.groupBy(*by, "rows").agg(
        *[F.max(F.when(F.col("place") == place, quantile)).alias(cut) for place, cut in enumerate(names)]
    )
    summary = store.save(summary, f"{name}-quartiles")
    rows = table.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_amount"))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("_amount").between(F.col("q1") - reach, F.col("q3") + reach)
    return join_totals(rows, summary, by, "rows").groupBy(*by, *names).agg(
        F.min(F.when(inside, F.col("_amount"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_amount"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )


@dataclass
class _Span:
    group: tuple
    first: int
    last: int
    below: int
    ranks: list[int]


def exact_quantiles(
    table: DataFrame, value: str, probabilities: Sequence[Fraction], by: Iterable[str] = ()
) -> dict[tuple, list[Quantile]]:
    """Linear-interpolation quantiles of an integer or decimal column, per group.

    Each pass cuts the spans of values that hold a wanted rank into equal slices, counts the rows per
    slice and keeps the slices with a wanted rank. At most ``SLICE_BUDGET`` counts reach the driver per
    pass, a value shared by many rows is one count, and no group is gathered in a task. The driver keeps a
    few numbers per group: for more than some hundred groups use ``group_quantiles``.
    """
    by = list(by)
    scale = getattr(table.schema[value].dataType, "scale", 0)
    units = (F.col(value) * F.lit(10**scale)).cast("bigint")
    rows = table.where(F.col(value).isNotNull()).select(*by, units.alias("_units"))
    extent = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("_units").alias("first"), F.max("_units").alias("last")
    )
    spans, positions, found = [], {}, {}
    for row in extent.collect():
        if not row["rows"]:
            continue
        group = tuple(row[key] for key in by)
        positions[group] = [Fraction(p) * (row["rows"] - 1) for p in probabilities]
        found[group] = {0: row["first"], row["rows"] - 1: row["last"]}
        wanted = {rank for position in positions[group] for rank in (position // 1, -(-position // 1))}
        spans.append(_Span(group, row["first"], row["last"], 0, sorted(wanted - found[group].keys())))

    while spans:
        still_open = []
        for span in spans:
            if span.first == span.last:
                found[span.group].update(dict.fromkeys(span.ranks, span.first))
            elif span.ranks:
                still_open.append(span)
        spans = _narrow(rows, by, still_open) if still_open else []

    unit = Decimal(1).scaleb(-scale)
    return {
        group: [
            Quantile(found[group][p // 1] * unit, found[group][-(-p // 1)] * unit, p - p // 1) for p in places
        ]
        for group, places in positions.items()
    }


def _narrow(rows: DataFrame, by: list[str], spans: list[_Span]) -> list[_Span]:
    slices = max(2, SLICE_BUDGET // len(spans))
    steps = [-(-(span.last - span.first + 1) // slices) for span in spans]
    counts: dict[int, list[tuple[int, int]]] = {}
    for row in _slice_counts(rows, by, spans, steps).collect():
        counts.setdefault(row["span"], []).append((row["slice"], row["rows"]))
    narrowed = []
    for i, span in enumerate(spans):
        below = span.below
        for index, count in sorted(counts[i]):
            ranks = [rank for rank in span.ranks if below <= rank < below + count]
            if ranks:
                first = span.first + index * steps[i]
                narrowed.append(_Span(span.group, first, min(first + steps[i] - 1, span.last), below, ranks))
            below += count
    return narrowed


def _slice_counts(rows: DataFrame, by: list[str], spans: list[_Span], steps: list[int]) -> DataFrame:
    """Rows per (span, slice). Spans of one group do not overlap, so a row falls in one slice at most."""
    units = F.col("_units")
    if by:
        schema = T.StructType(
            [T.StructField(f"_{key}", rows.schema[key].dataType) for key in by]
            + [T.StructField(name, T.LongType()) for name in ("span", "_first", "_last", "_step")]
        )
        bounds = rows.sparkSession.createDataFrame(
            [(*span.group, i, span.first, span.last, steps[i]) for i, span in enumerate(spans)], schema
        )
        inside = units.between(F.col("_first"), F.col("_last"))
        for key in by:
            inside &= F.col(key).eqNullSafe(F.col(f"_{key}"))
        # one row per open span: at most two per group and probability
        placed = rows.join(F.broadcast(bounds), inside).select(
            "span", F.call_function("div", units - F.col("_first"), F.col("_step")).alias("slice")
        )
    else:
        places = [
            F.when(
                units.between(span.first, span.last),
                F.struct(
                    F.lit(i).alias("span"),
                    F.call_function("div", units - F.lit(span.first), F.lit(step)).alias("slice"),
                ),
            )
            for i, (span, step) in enumerate(zip(spans, steps))
        ]
        placed = rows.select(F.coalesce(*places).alias("_place")).where(F.col("_place").isNotNull()).select("_place.*")
    return placed.groupBy("span", "slice").agg(F.count("*").alias("rows"))
