"""Weighted 0-100 scores over the signals that are present."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bound a value; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio_signal(ratio: Column) -> Column:
    return clamp(ratio, 0.0, 1.0) * 100.0


def scaled_signal(value: Column, full_scale: float) -> Column:
    """Magnitude as a share of the full scale, 0-100."""
    return clamp(F.abs(value) / full_scale * 100.0)


def weighted_score(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the non-null signals, their weights rescaled to one; null when no weight is left."""
    total = sum(weights.values())
    shares = {name: weights[name] / total for name in signals}
    zero = F.lit(0.0)
    available = reduce(
        lambda a, b: a + b, [F.when(s.isNotNull(), F.lit(shares[n])).otherwise(zero) for n, s in signals.items()]
    )
    score = reduce(
        lambda a, b: a + b,
        [F.coalesce(s * F.try_divide(F.lit(shares[n]), available), zero) for n, s in signals.items()],
    )
    return F.when(available > 0, F.bround(clamp(score), 2))


def score_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), "INSUFFICIENT_DATA")
        .when(score < 25, "LOW")
        .when(score < 50, "MODERATE")
        .when(score < 75, "HIGH")
        .otherwise("VERY_HIGH")
    )


def fixed(value: Column, places: int) -> Column:
    """Decimal text with a fixed number of places, null for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))
