"""All signals of the calculated indices, per route, window and date."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..operators import features, quality, signals
from ..operators.pairing import SLICE
from ..functions.text import finite
from ..session import staged
from .calculation import IndexRun, from_grid, historical_index


@dataclass(frozen=True)
class Signals:
    """Frames of one analysis; all lazy."""

    anomalies: DataFrame
    patterns: DataFrame
    confirmations: DataFrame
    shocks: DataFrame
    scores: DataFrame
    estimates: DataFrame
    warnings: DataFrame


@dataclass(frozen=True)
class Prepared:
    """What all signals start from, as written tables: the calculated grid with its results, and the source facts."""

    run: IndexRun
    facts: DataFrame


def prepare(observations: DataFrame, weights: DataFrame, allow_partial: bool = True) -> Prepared:
    """Two passes over the quotes, one for the pairs and one for the facts; every signal then reads rows per slice and source only."""
    grid, _ = staged(historical_index(observations, weights, allow_partial=allow_partial).grid, "grid")
    facts, _ = staged(signals.source_facts(observations), "facts")
    return Prepared(from_grid(grid, weights, allow_partial, F.date_sub("observation_date", 1)), facts)


def usable_indices(grid: DataFrame) -> DataFrame:
    """Route indices with a finite value; what is skipped is named by ``index_warnings``."""
    return grid.filter(finite(F.col("index_value")).isNotNull())


def index_warnings(grid: DataFrame, national: DataFrame, allow_partial: bool = False, windows: Sequence[str] = K.WINDOWS) -> DataFrame:
    """One row per route index of a wanted window that is absent or skipped, per date and window without a national result, and per window of
    a date whose calculation as a whole did not succeed.

    A date succeeds when every window has an acceptable national index; partial coverage is acceptable where the
    calculation allows it.
    """
    window = F.col("booking_window")
    tag = F.concat(F.lit("["), window, F.lit("] "))
    value = F.col("index_value")
    skipped = grid.filter(finite(value).isNull()).select(
        "observation_date", "booking_window", "route",
        F.concat(
            tag,
            F.when(value.isNull(), "Index value unavailable for route ").otherwise("Invalid index value skipped for route "),
            F.col("route"), F.lit("."),
        ).alias("warning"),
    )
    wanted = F.array(*[F.lit(w) for w in windows])
    # The sets are as long as the list of windows.
    absent = lambda df, *by: df.groupBy("observation_date", *by).agg(F.collect_set("booking_window").alias("_seen")).withColumn(
        "booking_window", F.explode(F.array_except(wanted, "_seen")))
    no_index = absent(grid, "route").select(
        "observation_date", "booking_window", "route", F.concat(tag, F.lit("No index result available for route "), F.col("route"), F.lit(".")).alias("warning"))
    dates = grid.select("observation_date").distinct().withColumn("booking_window", F.explode(wanted))
    known = national.select("observation_date", "booking_window")
    no_national = dates.join(known, ["observation_date", "booking_window"], "left_anti").select(
        "observation_date", "booking_window", F.lit(None).cast("string").alias("route"),
        F.concat(tag, F.lit("National result unavailable; coverage is unknown.")).alias("warning"))
    fine = ["SUCCESS", "PARTIAL_COVERAGE"] if allow_partial else ["SUCCESS"]
    whole = F.min(F.col("status").isin(*fine)).over(Window.partitionBy("observation_date"))  # a handful of windows per date
    failed = national.withColumn("_whole", whole).filter(~F.col("_whole")).select(
        "observation_date", "booking_window", F.lit(None).cast("string").alias("route"),
        F.concat(F.lit("Statistical Engine status: "), F.lit("INSUFFICIENT_DATA"), F.lit(".")).alias("warning"),
    )
    return skipped.unionByName(no_index).unionByName(no_national).unionByName(failed)


def analyze(
    grid: DataFrame, national: DataFrame, observations: DataFrame, missing_fares: DataFrame | None = None,
    freshness: DataFrame | None = None, route_quality: DataFrame | None = None, allow_partial: bool = False, facts: DataFrame | None = None,
) -> Signals:
    """Anomalies with explanation, patterns, source agreement, shocks, pressure, confidence and estimates.

    ``grid`` carries ``previous_index``; ``freshness`` has freshness_hours per date; ``route_quality`` has data_quality per
    slice. ``facts`` are the source facts of the observations where they were made before (``prepare``).
    """
    facts = signals.source_facts(observations) if facts is None else facts
    rows = usable_indices(grid)
    anomalies = signals.detect_anomalies(rows)
    anomalies = anomalies.withColumn("reason", F.when(F.col("detected"), signals.explanation()).otherwise(F.col("reason")))
    confirmations = signals.confirm_sources(signals.source_movements(signals.facts_means(facts)))

    groups = national.select("observation_date", "booking_window", "coverage_ratio")
    if freshness is None:
        groups = groups.withColumn("freshness_hours", F.lit(None).cast("double"))
    else:
        groups = groups.join(freshness.select("observation_date", "freshness_hours"), "observation_date", "left")

    movements = signals.shock_movements(signals.with_previous_change(rows))
    shocks = signals.detect_shocks(movements, groups, confirmations)

    volume = signals.facts_days(facts).drop("latest")
    scored = (
        anomalies.select(*SLICE, "percentage_change", "anomaly_score")
        .join(confirmations.select(*SLICE, "agreement_ratio"), SLICE, "left")
        .join(groups, ["observation_date", "booking_window"], "left")
        .join(volume, "observation_date", "left")
        .withColumn("anomaly_available", F.col("percentage_change").isNotNull())
    )
    if route_quality is not None:
        scored = scored.join(route_quality.select(*SLICE, "data_quality"), SLICE, "left")
    pressure = signals.pressure_score(scored.select(*SLICE, "percentage_change", "anomaly_score", "agreement_ratio"))
    confidence = signals.confidence_score(scored.drop("percentage_change", "anomaly_score"))
    scores = pressure.join(
        confidence.select(*SLICE, "coverage_ratio", "confidence_score", "confidence_level", "confidence_reason"), SLICE
    ).withColumns({"model_version": F.lit(K.MODEL_VERSION), "feature_version": F.lit(K.FEATURE_VERSION)})
    estimates = quality.missing_fare_estimate(observations if missing_fares is None else missing_fares)
    return Signals(
        anomalies, features.persistent_pattern(rows), confirmations, shocks, scores, estimates, index_warnings(grid, national, allow_partial)
    )
