"""Movement, rolling and freshness features of ordered series."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fares import percent_change
from ..functions.scores import clamp

SERIES = ("route", "booking_window")


def _order(keys: Sequence[str], date: str):
    return Window.partitionBy(*keys).orderBy(date)


def movement(series: DataFrame, value: str, keys: Sequence[str] = SERIES, date: str = "observation_date") -> DataFrame:
    """Previous value, percentage change, rate (the same) and acceleration, to four places.

    A non-positive value counts as absent.
    """
    w = _order(keys, date)
    usable = F.when(F.col(value) > 0, F.col(value))
    rows = series.withColumn("_v", usable).withColumn("previous_value", F.lag("_v").over(w))
    rows = rows.withColumn("_change", percent_change(F.col("_v"), F.col("previous_value")))
    rows = rows.withColumn("_before", F.lag("_change").over(w))
    change = F.bround("_change", 4)
    return rows.withColumns(
        {
            "percentage_change": change,
            "rate_of_change": change,
            "acceleration": F.bround(F.col("_change") - F.col("_before"), 4),
        }
    ).drop("_v", "_change", "_before")


def rolling(series: DataFrame, value: str, keys: Sequence[str] = SERIES, date: str = "observation_date", size: int = 7) -> DataFrame:
    """Mean, median and population deviation of the last ``size`` positive values, the current one included."""
    if size < 1:
        raise ValueError("size must be at least 1")
    w = _order(keys, date).rowsBetween(-(size - 1), 0)
    v = F.col(value)
    return series.filter(v > 0).withColumns(
        {
            "rolling_mean": F.bround(F.avg(v).over(w), 2),
            "rolling_median": F.bround(F.percentile(v, F.lit(0.5)).over(w), 2),
            "rolling_volatility": F.bround(F.stddev_pop(v).over(w), 2),
        }
    )


def freshness_hours(timestamp: Column, reference: Column) -> Column:
    """Age in hours, never negative, to two places."""
    seconds = (F.unix_micros(reference) - F.unix_micros(timestamp)) / 1e6
    return F.when(seconds.isNotNull(), F.bround(F.greatest(seconds, F.lit(0.0)) / 3600.0, 2))


def feature_vectors(
    observations: DataFrame, agreement: DataFrame, coverage: DataFrame, reference: Column | None = None, size: int = 7,
) -> DataFrame:
    """One feature row per (route, window, date), using nothing later than the date itself.

    ``agreement`` has agreement_ratio per slice, ``coverage`` has coverage_ratio per (date, window).
    """
    key = [*SERIES, "observation_date"]
    daily = observations.filter(F.col("comparable_fare") > 0).groupBy(*key).agg(
        F.avg("comparable_fare").alias("current_fare"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_distinct(F.when(F.trim("source") != "", F.trim("source"))).alias("source_count"),
        F.max("observation_timestamp").alias("latest"),
    )
    at = F.date_add("observation_date", 1).cast("timestamp") if reference is None else reference
    rows = rolling(movement(daily, "current_fare"), "current_fare", size=size)
    return (
        rows.withColumn("freshness_hours", freshness_hours(F.col("latest"), at))
        .join(agreement.select(*key, clamp(F.col("agreement_ratio"), 0.0, 1.0).alias("cross_source_agreement")), key, "left")
        .join(
            coverage.select("observation_date", "booking_window", clamp(F.col("coverage_ratio"), 0.0, 1.0).alias("coverage_ratio")),
            ["observation_date", "booking_window"], "left",
        )
        .drop("latest")
    )


def persistent_pattern(
    series: DataFrame, value: str = "index_value", keys: Sequence[str] = SERIES, date: str = "observation_date",
    minimum_change: float = 1.0, movements: int = 3,
) -> DataFrame:
    """UPWARD or DOWNWARD when the last movements all reach the minimum change, at every point of the series."""
    w = _order(keys, date)
    recent = w.rowsBetween(-(movements - 1), 0)
    rows = series.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(w))
    rows = rows.withColumns(
        {
            "_n": F.count("_d").over(recent), "_low": F.min("_d").over(recent), "_high": F.max("_d").over(recent),
            "_avg": F.avg("_d").over(recent),
        }
    )
    enough = F.col("_n") >= movements
    up, down = F.col("_low") >= minimum_change, F.col("_high") <= -minimum_change
    said = F.concat(
        F.lit("Persistent "), F.lower("pattern"), F.lit(f" pattern detected across {movements} consecutive movements.")
    )
    return rows.withColumns(
        {
            "pattern": F.when(~enough, "INSUFFICIENT_DATA").when(up, "UPWARD").when(down, "DOWNWARD").otherwise("STABLE"),
            "consecutive_movements": F.when(enough, movements).otherwise(0),
            "average_change": F.when(enough, F.col("_avg")),
        }
    ).select(
        *keys, date, value, "pattern", F.col("pattern").isin("UPWARD", "DOWNWARD").alias("detected"), "consecutive_movements",
        "average_change", F.when(F.col("pattern") == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA").otherwise("SUCCESS").alias("status"),
        F.when(F.col("pattern") == "INSUFFICIENT_DATA", "Insufficient historical index values for pattern detection.")
        .when(F.col("pattern") == "STABLE", "No persistent directional pattern detected in the recent movements.")
        .otherwise(said).alias("reason"),
    )


def latest_pattern(series: DataFrame, value: str = "index_value", keys: Sequence[str] = SERIES, date: str = "observation_date", **options) -> DataFrame:
    """The pattern at the last point of each series."""
    rows = persistent_pattern(series, value, keys, date, **options)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), date).alias("r")).select(*keys, "r.*")
