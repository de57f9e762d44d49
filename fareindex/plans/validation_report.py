"""Validation of the stored index against the external monthly series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..operators import monthly, validation


@dataclass(frozen=True)
class ValidationReport:
    """Result tables of one validation; all lazy."""

    metrics: DataFrame
    history: DataFrame
    months: DataFrame
    comparison: DataFrame
    reference: DataFrame
    alignment: DataFrame
    period: DataFrame


def alignment_summary(aligned: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: number and list of the months in both series, and whether the reference is there and meets the own months."""
    common = F.col("status") == "ALIGNED"
    months = aligned.agg(F.count_if(common).alias("overlapping_months"), F.sort_array(F.collect_list(F.when(common, F.col("month")))).alias("aligned_months"))
    records = reference.agg(F.count(F.lit(1))).scalar()
    return months.select(
        "overlapping_months", F.when(records == 0, "NOT_CONNECTED").when(F.col("overlapping_months") > 0, "CONNECTED").otherwise("NO_OVERLAP").alias("status"), "aligned_months",
    )


def calculated_period(results: DataFrame, window: str = K.HEADLINE_WINDOW) -> DataFrame:
    """One row: first and last date with a successful index of the window, as text; null without one."""
    used = results.filter((F.col("booking_window") == window) & (F.col("status") == "SUCCESS") & F.col("index_value").isNotNull())
    first, last = F.min("observation_date").cast("string"), F.max("observation_date").cast("string")
    return used.agg(F.when(F.min("observation_date") < F.max("observation_date"), F.concat(first, F.lit(" to "), last)).otherwise(first).alias("period"))


def own_months(results: DataFrame, window: str = K.HEADLINE_WINDOW) -> DataFrame:
    """Monthly means of the window; without any, the level of the latest successful result of any window, in today's month."""
    months = monthly.monthly_mean(results, window)
    latest = F.max_by("index_value", "observation_date").cast("double")
    spare = results.filter("status = 'SUCCESS'").agg(F.coalesce(latest, F.lit(100.0)).alias("own_index")).select(F.date_format(F.current_date(), "yyyy-MM").alias("month"), "own_index")
    none = months.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return months.unionByName(spare.filter(none))


def backtest(calculated: DataFrame, reference: DataFrame, start, end, windows=K.WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Metrics per window in long form, and the summary with matched days and status."""
    aligned = validation.align_daily(calculated, reference, start, end, windows)
    days = F.date_diff(end, start) + 1
    return validation.all_metrics(aligned, days, windows), validation.backtest_summary(aligned, start, end, windows)


def reference_description(reference: DataFrame) -> DataFrame:
    """One row: how many months, first and latest date, connection status; value and description of the latest month."""
    latest = [F.max_by(c, "reference_date").alias(c) for c in ("item", "item_code", "base_year", "series", "frequency", "state", "sector") if c in reference.columns]
    return reference.agg(
        F.count(F.lit(1)).alias("records"), F.min("reference_date").alias("first_date"), F.max("reference_date").alias("latest_date"),
        F.max_by(F.col("index_value").cast("double"), "reference_date").alias("latest_value"), *latest,
    ).withColumn("connected", F.col("records") > 0)


def validation_report(results: DataFrame, route_indices: DataFrame, reference: DataFrame, window: str = K.HEADLINE_WINDOW) -> ValidationReport:
    own = own_months(results, window)
    months_ref = monthly.monthly_reference(reference)
    aligned = monthly.align_months(own, months_ref)
    comparison = monthly.month_comparison(aligned)
    return ValidationReport(
        metrics=_metric_table(comparison, results, route_indices, reference, window),
        history=monthly.overlay_months(results, months_ref, window),
        months=monthly.rebase_months(aligned),
        comparison=comparison,
        reference=reference_description(reference),
        alignment=alignment_summary(aligned, reference),
        period=calculated_period(results, window),
    )


def _metric_table(comparison: DataFrame, results: DataFrame, route_indices: DataFrame, reference: DataFrame, window: str) -> DataFrame:
    """The metric table with display values and descriptions, one row per metric."""
    records = reference.agg(F.count(F.lit(1))).scalar()
    one = comparison.select(
        F.when(records == 0, "NOT_CONNECTED").otherwise(F.col("correlation_status")).alias("link"),
        F.coalesce(F.format_string("%.4f", "correlation"), F.lit("N/A")).alias("r"), "correlation", "difference_label",
        "absolute_difference", "percentage_difference",
    )
    shown = lambda text, value: F.when(value.isNotNull(), text).otherwise("N/A")
    versioned = "calculation_version" in route_indices.columns and "calculation_version" in results.columns
    coverage = monthly.corridor_coverage(route_indices, window, results if versioned else None).select(F.struct("coverage_text", "status")).scalar()
    spread = monthly.daily_volatility(results, window).select(F.struct("volatility_text", "status")).scalar()
    rows = one.withColumns({"c": coverage, "s": spread})
    texts = F.create_map(*[F.lit(x) for pair in K.METRIC_TEXTS.items() for x in pair])
    row = lambda name, value, status: F.struct(name.alias("metric"), value.alias("value"), status.alias("status"), texts[name].alias("description"))
    link = F.col("link")
    return rows.select(
        F.inline(
            F.array(
                row(F.lit("Pearson Correlation (r)"), shown(F.col("r"), F.col("correlation")), link),
                row(F.lit("Spearman Rank Correlation (rho)"), F.lit("N/A"), link),
                row(F.col("difference_label"),
                    shown(F.format_string("%.2f pts", "absolute_difference"), F.col("absolute_difference")), link),
                row(F.lit("Percentage Difference"),
                    shown(F.format_string("%+.2f%%", "percentage_difference"), F.col("percentage_difference")), link),
                row(F.lit("Corridor Coverage"), F.coalesce("c.coverage_text", F.lit("0.0%")), F.coalesce("c.status", F.lit("PARTIAL"))),
                row(F.lit("Index Stability"), F.coalesce("s.volatility_text", F.lit("0.00")), F.coalesce("s.status", F.lit("STABLE"))),
            )
        )
    )
