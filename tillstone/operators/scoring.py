"""Quintile scores on interpolated edges."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillstone.operators.quantiles import Quantile

INNER = [Fraction(k, 5) for k in range(1, 5)]
EDGES = [Fraction(0), *INNER, Fraction(1)]


class RepeatedEdgesError(ValueError):
    """Two quantile edges coincide, so the bins between them would be empty."""


def check_edges(edges: Sequence[Quantile], column: str, on_duplicate_edges: str) -> list[Quantile]:
    """The inner edges; with ``merge`` an edge equal to its neighbour is dropped."""
    kept = [edges[0]]
    for edge in edges[1:]:
        if edge.value != kept[-1].value:
            kept.append(edge)
    if len(kept) < len(edges) and on_duplicate_edges == "error":
        raise RepeatedEdgesError(f"quantile edges of {column} must be unique")
    least, most = edges[0].value, edges[-1].value
    return [edge for edge in kept if least < edge.value < most]


def score_above(value: Column, edges: Sequence[Quantile]) -> Column:
    """1 plus the number of edges below the value (bins are closed on the right).

    No value lies strictly between the two neighbours of an edge, so being above the edge means being
    above its lower neighbour; the comparison needs no fractions.
    """
    score = F.lit(1)
    for edge in edges:
        score = score + F.when(value > F.lit(edge.lower), 1).otherwise(0)
    return score


def score_of_position(position: Column, rows: Column, tiles: int = 5) -> Column:
    """Quantile bin of a 1-based rank; unlike NTILE the bins are cut at interpolated ranks."""
    score = F.lit(1)
    for k in range(1, tiles):
        lower = F.call_function("div", (rows - 1) * k, F.lit(tiles)) + 1
        score = score + F.when(position > lower, 1).otherwise(0)
    return score
