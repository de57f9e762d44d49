"""Exact interpolated quantiles per group, without holding a group in one task.

Repeated values are counted before the shuffle, the counts are placed in narrow value bands, and only the bands that
hold a wanted rank are sorted. A group may therefore be of any size: what one task sees is the list of bands of a group
(limited by the number range) or the distinct values of a single band.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BANDS_PER_UNIT = 1000  # width of a band: 0.1 % of the value, whatever its size
MIDDLE = 1_000_000     # above the band number of every double, so that all magnitudes stand on one side of zero


def _band(value: Column) -> Column:
    """A non-decreasing integer of the value (sign, then magnitude on a log scale); zero has a band of its own."""
    size = F.floor(F.least(F.ln(F.abs(value)) * BANDS_PER_UNIT, F.lit(float(MIDDLE - 1)))) + MIDDLE
    return F.when(value < 0, -size).when(value > 0, size).when(value == 0, F.lit(0))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float], count_name: str = "n_values",
    few_groups: bool = False,
) -> DataFrame:
    """One row per group: the number of values and one column per named probability.

    ``few_groups`` states that the number of groups is bounded (one per calendar day): the wanted ranks, at most two
    per probability and group, are then broadcast to the counts.
    """
    groups = list(groups)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", _band(F.col("_v")))
        .filter(F.col("_band").isNotNull())  # stated here so that both uses below share one shuffle
    )
    order = Window.partitionBy(*groups).orderBy("_band") if groups else Window.orderBy("_band")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = (
        counts.groupBy(*groups, "_band")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_total", F.sum("_size").over(whole))
        .withColumn("_before", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    )
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        ranks[name] = (low, high, position - low)
    holds = [
        (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_size"))
        for low, high, _ in ranks.values() for rank in (low, high)
    ]
    wanted = bands.filter(reduce(lambda a, b: a | b, holds)).drop("_size")
    inside = Window.partitionBy(*groups, "_band").orderBy("_v")
    placed = (
        counts.join(F.broadcast(wanted) if few_groups else wanted, [*groups, "_band"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    picks = [F.first("_total").alias(count_name)]
    for name, (low, high, _) in ranks.items():
        for tag, rank in (("lo", low), ("hi", high)):
            hit = (rank >= F.col("_start")) & (rank < F.col("_end"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{tag}"))
    result = placed.groupBy(*groups).agg(*picks)
    shares = []
    for name, p in probabilities.items():
        position = (F.col(count_name) - 1) * F.lit(float(p))
        low_v, high_v = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        shares.append((low_v + (position - F.floor(position)) * (high_v - low_v)).alias(name))
    return result.select(*groups, count_name, *shares)
