"""Index calculation for one transition, a history of days, or a fixed base day."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..operators import index as ix
from ..operators import pairing


@dataclass(frozen=True)
class IndexRun:
    """Frames of one calculation; all lazy."""

    grid: DataFrame
    national: DataFrame
    contributions: DataFrame
    dates: DataFrame

    def checksums(self, prefix: str = "OBS") -> DataFrame:
        return ix.execution_checksum(self.national, self.dates, prefix)

    def overall_status(self, allow_partial: bool) -> DataFrame:
        """SUCCESS when every window of the date has an acceptable national index."""
        fine = ["SUCCESS", "PARTIAL_COVERAGE"] if allow_partial else ["SUCCESS"]
        return self.national.groupBy("observation_date").agg(
            F.when(F.min(F.col("status").isin(*fine)), "SUCCESS").otherwise("INSUFFICIENT_DATA").alias("status"),
            F.flatten(
                F.array_sort(
                    F.collect_list(
                        F.transform("warnings", lambda w: F.concat(F.lit("["), F.col("booking_window"), F.lit("] "), w))
                    )
                )
            ).alias("warnings"),
        )


def _date_counts(grid: DataFrame, previous_date: Column) -> DataFrame:
    return grid.groupBy("observation_date").agg(
        F.sum("num_current_observations").alias("current_count"),
        F.sum("num_previous_observations").alias("previous_count"),
        F.count_distinct("route").alias("routes_count"),
    ).withColumn("previous_date", previous_date)


def _finish(grid: DataFrame, weights: DataFrame, allow_partial: bool, min_coverage: float, previous_date: Column) -> IndexRun:
    weights = ix.one_version(weights)
    national = ix.national_index(grid, weights, allow_partial, min_coverage)
    parts = ix.contributions(grid, weights, allow_partial, min_coverage)
    return IndexRun(grid, national, parts, _date_counts(grid, previous_date))


def from_grid(grid: DataFrame, weights: DataFrame, allow_partial: bool, previous_date: Column, min_coverage: float = K.MIN_COVERAGE) -> IndexRun:
    """The run of a grid that was stored in between: results and contributions start from its rows."""
    return _finish(grid, weights, allow_partial, min_coverage, previous_date)


def historical_index(
    observations: DataFrame, weights: DataFrame, windows: Sequence[str] = K.WINDOWS, allow_partial: bool = False,
    min_coverage: float = K.MIN_COVERAGE, min_pairs: int = 1, include_travel_date: bool = False,
    allow_suspect: bool = False, weight_version: str | None = None,
) -> IndexRun:
    """All day-to-day transitions at once; a missing day starts anew."""
    weights = ix.one_version(weights, weight_version)
    products = pairing.consecutive_products(observations, include_travel_date, allow_suspect)
    slices = ix.calendar_transitions(ix.elementary_slices(products, min_pairs=min_pairs))
    grid = ix.previous_day_index(ix.route_grid(slices, windows, min_pairs))
    return _finish(grid, weights, allow_partial, min_coverage, F.date_sub("observation_date", 1))


def daily_index(
    current: DataFrame, previous: DataFrame, observation_date: Column, previous_date: Column, weights: DataFrame,
    windows: Sequence[str] = K.WINDOWS, allow_partial: bool = False, min_coverage: float = K.MIN_COVERAGE,
    min_pairs: int = 1, stored_previous: DataFrame | None = None, weight_version: str | None = None,
) -> IndexRun:
    """One transition between two given batches; ``stored_previous`` supplies yesterday's route indices."""
    weights = ix.one_version(weights, weight_version)
    products = pairing.two_day_products(current, previous, observation_date)
    grid = ix.route_grid(ix.elementary_slices(products, min_pairs=min_pairs), windows, min_pairs)
    if stored_previous is None:
        grid = grid.withColumn("previous_index", F.lit(None).cast("double"))
    else:
        grid = ix.stored_previous_index(grid, weights, stored_previous)
    return _finish(grid, weights, allow_partial, min_coverage, previous_date)


def fixed_base_index(
    observations: DataFrame, weights: DataFrame, base_date: Column | None = None, windows: Sequence[str] = K.WINDOWS,
    allow_partial: bool = True, min_coverage: float = K.MIN_COVERAGE, min_pairs: int = 1, weight_version: str | None = None,
) -> IndexRun:
    """Every later date against the base date; contributions use the last known route index."""
    weights = ix.one_version(weights, weight_version)
    base_date = ix.first_day(observations) if base_date is None else base_date
    slices = ix.fixed_base_slices(observations, base_date, min_pairs=min_pairs)
    grid = ix.carried_previous_index(ix.route_grid(slices, windows, min_pairs), weights)
    return _finish(grid, weights, allow_partial, min_coverage, base_date)


def calendar_gaps(observations: DataFrame) -> DataFrame:
    """The gaps between observed days, with the warning a history run gives for each."""
    days = observations.select("observation_date").distinct()
    before = F.lag("observation_date").over(Window.orderBy("observation_date"))  # one row per calendar day
    return (
        days.withColumn("previous_date", before)
        .filter("date_diff(observation_date, previous_date) > 1")
        .withColumn(
            "warning",
            F.concat(
                F.lit("Missing historical dates between "), F.col("previous_date").cast("string"), F.lit(" and "),
                F.col("observation_date").cast("string"), F.lit("; no cross-gap calculation created."),
            ),
        )
    )
