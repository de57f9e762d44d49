"""Fare arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StringType

from ..constants import BASE_SHARE, COMPONENT_TOLERANCE, TAX_SHARE
from .text import finite, parse_fare


def fare_number(value: Column, data_type: DataType | None = None) -> Column:
    """A finite double from a numeric or text fare column."""
    return parse_fare(value) if isinstance(data_type, StringType) else finite(value)


def comparable_fare(base: Column, taxes: Column, charges: Column, total: Column) -> Column:
    """Sum of three positive components, else a positive total, else null."""
    whole = (base > 0) & (taxes > 0) & (charges > 0)
    return F.when(whole, base + taxes + charges).when(total > 0, total)


def split_total(total: Column, base: Column, taxes: Column, charges: Column, tolerance: float | None = COMPONENT_TOLERANCE):
    """Component triple, derived from the total when the base is missing or the sum is off.

    With ``tolerance=None`` only a missing base triggers the derivation.
    """
    zero = F.lit(0.0)
    found = F.coalesce(base, zero) + F.coalesce(taxes, zero) + F.coalesce(charges, zero)
    derive = base.isNull()
    if tolerance is not None:
        derive = derive | (F.abs(found - total) > tolerance)
    derive = F.coalesce((total > 0) & derive, F.lit(False))
    new_base = F.bround(total * BASE_SHARE, 2)
    new_taxes = F.bround(total * TAX_SHARE, 2)
    rest = F.bround(total - new_base - new_taxes, 2)
    return (
        F.when(derive, new_base).otherwise(base),
        F.when(derive, new_taxes).otherwise(taxes),
        F.when(derive, rest).otherwise(charges),
    )


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent, null when the previous value is null or zero."""
    return F.when(previous != 0, (current - previous) / previous * 100.0)
