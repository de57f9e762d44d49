"""Coverage, validity, freshness, daily quality rows and the missing-fare estimate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.local import small_table
from .quantiles import exact_quantiles


def coverage(observations: DataFrame, expected: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the expected values of ``name`` that were observed; 0 when nothing is expected.

    ``expected`` has the one column ``name`` and is duplicate-free. Groups without any expected value get 0.
    """
    by = list(by)
    wanted = F.coalesce(expected.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    seen = observations.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(*by, name).agg(F.count(F.lit(1)).alias("_n"))
    hits = seen.join(expected.select(name, F.lit(True).alias("_hit")), name, "left")
    return hits.groupBy(*by).agg(F.count("_hit").alias("observed")).select(
        *by, "observed", wanted.alias("expected"),
        F.coalesce(F.try_divide("observed", wanted), F.lit(0.0)).alias(f"{name}_coverage"),
    )


def expected_values(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """The expected values as a frame of the same session."""
    return small_table(df.sparkSession, [(v,) for v in values], f"{name} string")


def window_coverage(observations: DataFrame, by: Sequence[str] = (), windows: Sequence[str] = K.WINDOWS) -> DataFrame:
    return coverage(observations, expected_values(observations, "booking_window", windows), "booking_window", by)


def status_counts(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per quality status, with zero rows for absent statuses."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(s) for s in K.QUALITY_STATUSES]),
        F.array(*[F.count_if(F.col("quality_status") == s) for s in K.QUALITY_STATUSES]),
    )
    return observations.groupBy(*by).agg(counts.alias("c")).select(*by, F.explode("c").alias("quality_status", "observations"))


def validity_rate(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    valid = F.coalesce(F.col("quality_status") == "VALID", F.lit(False)).cast("double")
    return observations.groupBy(*by).agg(F.coalesce(F.avg(valid), F.lit(0.0)).alias("validity_rate"))


def freshness_minutes(timestamp: Column, now: Column) -> Column:
    """Age of a row in minutes at the given time."""
    return (F.unix_micros(now) - F.unix_micros(timestamp)) / 6e7


def average_freshness(observations: DataFrame, now: Column, by: Sequence[str] = ()) -> DataFrame:
    age = F.avg(freshness_minutes(F.col("observation_timestamp"), now))
    return observations.groupBy(*by).agg(F.coalesce(age, F.lit(0.0)).alias("average_freshness_minutes"))


def daily_quality_metrics(
    observations: DataFrame, rejected_rows: DataFrame, expected_routes: DataFrame, now: Column | None = None,
) -> DataFrame:
    """One row per date and source: counts, coverage of the expected routes, freshness at the end of the day."""
    routes = expected_routes.select("route", F.lit(True).alias("_hit"))
    wanted = F.coalesce(expected_routes.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    end_of_day = F.date_add("metric_date", 1).cast("timestamp") if now is None else now
    key = ["metric_date", "source"]
    # Rows collapse to one per (date, source, route) before the join with the expected routes.
    per_route = observations.withColumnRenamed("observation_date", "metric_date").groupBy(*key, "route").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality_status") == "OUTLIER").alias("outliers"),
        F.count_if(F.col("quality_status") == "EXCLUDED").alias("invalid"),
        F.max("observation_timestamp").alias("latest"),
    )
    kept = per_route.join(routes, "route", "left").groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("outliers").alias("outliers"), F.sum("invalid").alias("invalid"),
        F.count("_hit").alias("hits"), F.max("latest").alias("latest"),
    )
    lost = rejected_rows.groupBy(F.col("observation_date").alias("metric_date"), "source").agg(F.count(F.lit(1)).alias("lost"))
    joined = kept.join(lost, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "metric_date", F.lit(None).cast("string").alias("route"), "source",
        (zero("n") + zero("lost")).alias("observation_count"),
        F.coalesce(F.try_divide("hits", wanted), F.lit(0.0)).cast("decimal(6,4)").alias("route_coverage"),
        F.when(zero("n") > 0, 1).otherwise(0).cast("decimal(6,4)").alias("source_coverage"),
        F.floor(freshness_minutes(F.col("latest"), end_of_day)).cast("int").alias("freshness_minutes"),
        zero("lost").alias("missing_observations"),
        zero("invalid").alias("invalid_observations"),
        zero("outliers").alias("anomalous_valid_observations"),
        F.lit("COMPLETE").alias("status"),
        end_of_day.alias("generated_at"),
    )


def daily_assessed(rows: DataFrame, expected_routes: DataFrame, now: Column | None = None) -> DataFrame:
    """The metrics of ``daily_quality_metrics`` from an assessed table (``cleaning.assessed``) in one aggregation, with the counts by status.

    Rejected quotes without a known source belong to no row.
    """
    lost, status = F.col("quality_status") == "REJECTED", F.col("quality_status")
    routes = expected_routes.select("route", F.lit(True).alias("_hit"))
    wanted = F.coalesce(expected_routes.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    end_of_day = F.date_add("metric_date", 1).cast("timestamp") if now is None else now
    key = ["metric_date", "source"]
    per_route = rows.filter("source is not null").select(
        F.col("observation_date").alias("metric_date"), "source", F.when(~lost, F.col("route")).alias("route"), "quality_status",
        F.when(~lost, F.col("observation_timestamp")).alias("_at"),
    ).groupBy(*key, "route").agg(
        F.count_if(~lost).alias("n"), F.count_if(lost).alias("lost"), F.max("_at").alias("latest"),
        *[F.count_if(status == s).alias(s.lower()) for s in ("VALID", "SUSPECT", "EXCLUDED", "OUTLIER")],
    )
    counts = ("n", "lost", "valid", "suspect", "excluded", "outlier")
    daily = per_route.join(routes, "route", "left").groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in counts], F.count("_hit").alias("hits"), F.max("latest").alias("latest")
    )
    return daily.select(
        "metric_date", F.lit(None).cast("string").alias("route"), "source",
        (F.col("n") + F.col("lost")).alias("observation_count"),
        F.coalesce(F.try_divide("hits", wanted), F.lit(0.0)).cast("decimal(6,4)").alias("route_coverage"),
        F.when(F.col("n") > 0, 1).otherwise(0).cast("decimal(6,4)").alias("source_coverage"),
        F.floor(freshness_minutes(F.col("latest"), end_of_day)).cast("int").alias("freshness_minutes"),
        F.col("lost").alias("missing_observations"), F.col("excluded").alias("invalid_observations"),
        F.col("outlier").alias("anomalous_valid_observations"), F.lit("COMPLETE").alias("status"), end_of_day.alias("generated_at"),
        *[F.col(c).alias(f"_{c}") for c in ("valid", "suspect", "excluded", "outlier")],
    )


def summarize_assessed(rows: DataFrame, expected_routes: DataFrame, now: Column | None = None) -> DataFrame:
    """``quality_summary`` of the stored rows and the latest metrics, both from one aggregation of an assessed table."""
    daily = daily_assessed(rows, expected_routes, now)
    held = {"total_observations": F.col("_valid") + F.col("_suspect") + F.col("_outlier"), "valid_observations": F.col("_valid"),
            "suspect_observations": F.col("_suspect"), "excluded_observations": F.lit(0), "outlier_count": F.col("_outlier")}
    latest = F.max_by(F.struct("source", "route_coverage", "source_coverage", "freshness_minutes", "generated_at"), F.struct("generated_at", "source"))
    counts = daily.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in held.items()], latest.alias("_m"))
    return _summary(counts, list(held))


def quality_summary(observations: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: counts by status, the latest metric row and source health."""
    counts = observations.agg(
        F.count(F.lit(1)).alias("total_observations"),
        *[F.count_if(F.col("quality_status") == s).alias(n) for s, n in (
            ("VALID", "valid_observations"), ("SUSPECT", "suspect_observations"), ("EXCLUDED", "excluded_observations"),
            ("OUTLIER", "outlier_count"))],
    )
    latest = metrics.agg(
        F.max_by(
            F.struct("source", "route_coverage", "source_coverage", "freshness_minutes", "generated_at"),
            F.struct("generated_at", "source"),
        )
    ).scalar()
    return _summary(counts.withColumn("_m", latest), counts.columns)


def _summary(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The summary row of counts and ``_m``, the latest metric row."""
    source_coverage = F.coalesce(F.col("_m.source_coverage").cast("double"), F.lit(1.0))
    return counts.select(
        *names,
        F.coalesce(F.col("_m.route_coverage").cast("double"), F.lit(1.0)).alias("route_coverage"),
        source_coverage.alias("source_coverage"),
        F.coalesce(F.col("_m.freshness_minutes"), F.lit(1)).alias("freshness_minutes"),
        F.when(F.col("valid_observations") > 0, "OPTIMAL").otherwise("NO_DATA").alias("status"),
        F.coalesce(F.col("_m.source"), F.lit("MOCK")).alias("source"),
        F.lit("HEALTHY").alias("source_status"),
        F.col("_m.generated_at").alias("last_collection"),
        F.bround(source_coverage * 100, 1).alias("coverage_percent"),
    )


def missing_fare_estimate(
    observations: DataFrame, by: Sequence[str] = ("route", "booking_window"), minimum: int = 3, fare: str = "comparable_fare"
) -> DataFrame:
    """Median of the positive fares per group as a flagged estimate; never part of the index."""
    if minimum < 1:
        raise ValueError("minimum must be at least 1")
    by = list(by)
    groups = observations.groupBy(*by).agg(F.count_if(F.col(fare) > 0).alias("comparable_observations"))
    median = exact_quantiles(observations.filter(F.col(fare) > 0), by, fare, {"median": 0.5})
    n = F.col("comparable_observations")
    enough = n >= minimum
    return groups.join(median.drop("n_values"), by, "left").select(
        *by, "comparable_observations",
        F.when(enough, F.bround("median", 2)).alias("estimated_fare"),
        F.when(~enough, "INSUFFICIENT_DATA").when(n >= 5, "HIGH").otherwise("MODERATE").alias("confidence"),
        enough.alias("estimated"),
        F.when(enough, "MEDIAN").alias("estimation_method"),
        F.when(
            enough,
            F.concat(
                F.lit("Supporting estimate based on the median of "), n.cast("string"),
                F.lit(" comparable observations. The estimated value must remain explicitly identified as estimated and "
                      "must not be silently treated as an actual fare."),
            ),
        ).otherwise(
            "Insufficient comparable observations for a supporting missing-data estimate. No replacement value was produced."
        ).alias("reason"),
    )


def source_volume(observations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct non-blank sources and number of rows per group."""
    source = F.trim("source")
    return observations.groupBy(*by).agg(
        F.count_distinct(F.when(source != "", source)).alias("source_count"),
        F.count(F.lit(1)).alias("observation_count"),
    )
