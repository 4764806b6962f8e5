"""Money, shares and exact rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(30,2)"
LOW_BITS = 20


def half_up(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``numerator / denominator`` rounded half away from zero, as a double.

    The quotient is taken on exact decimals, so a tie such as 50.005 rounds the same way whatever the
    order in which the rows were added up. A zero or null denominator gives null.
    """
    top = F.abs(numerator.cast(WIDE)) * F.lit(2 * 10**digits)
    bottom = F.abs(denominator.cast(WIDE))
    units = F.call_function("div", top + bottom, bottom * F.lit(2))
    sign = F.signum(numerator.cast("double")) * F.signum(denominator.cast("double"))
    return F.when(bottom != 0, sign * units.cast("double") / F.lit(float(10**digits)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share of ``whole`` held by ``part``, in percent."""
    return half_up(part * F.lit(100), whole, digits)


def money(amount: Column) -> Column:
    """A two-place amount as it leaves a report."""
    return F.round(amount, 2).cast("double")


def to_cents(amount: Column) -> Column:
    return (amount * F.lit(100)).cast("bigint")


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")


def sum_cents(cents: Column) -> Column:
    """Exact total of whole cents as a two-place decimal.

    High and low bits are added up apart as 64-bit integers, which takes less than half the time of a
    decimal sum and holds any ``decimal(12,2)`` amounts of up to 9e12 rows.
    """
    high = F.sum(F.shiftright(cents, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(cents.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(20,0)")
    return ((high * F.lit(1 << LOW_BITS) + low) * F.lit(Decimal("0.01"))).cast("decimal(22,2)")


def millions(amount: Column) -> Column:
    return amount.cast("double") / F.lit(1e6)


def thousands(amount: Column) -> Column:
    return amount.cast("double") / F.lit(1e3)


def net_amount(unit_amount: Column, quantity: Column, discount_pct: Column) -> Column:
    """Amount due for ``quantity`` units after a whole-percent discount, to the cent."""
    gross = unit_amount.cast("decimal(12,2)") * quantity.cast("decimal(10,0)")
    kept = (F.lit(100) - discount_pct).cast("decimal(3,0)")
    return F.round(gross * kept * F.lit(Decimal("0.01")), 2)


def display_amount(amount: Column, digits: int = 0) -> Column:
    """Thousands-separated text for printing."""
    return F.format_number(amount, digits)
