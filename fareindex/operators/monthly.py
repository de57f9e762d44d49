"""Monthly comparison with an external price index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K


def month_key(date: str = "observation_date") -> Column:
    return F.date_format(date, "yyyy-MM")


def monthly_mean(results: DataFrame, window: str = K.HEADLINE_WINDOW) -> DataFrame:
    """Mean of the daily SUCCESS levels of one window per month, four places."""
    used = results.filter((F.col("booking_window") == window) & (F.col("status") == "SUCCESS") & F.col("index_value").isNotNull())
    return used.groupBy(month_key().alias("month")).agg(F.bround(F.avg(F.col("index_value").cast("double")), 4).alias("own_index"))


def monthly_reference(reference: DataFrame) -> DataFrame:
    """Reference value per month; the latest row wins should a month occur twice."""
    return reference.groupBy(month_key("reference_date").alias("month")).agg(
        F.max_by(F.col("index_value").cast("double"), F.col("reference_date")).alias("reference_index")
    )


def align_months(own: DataFrame, reference: DataFrame) -> DataFrame:
    """All months of both series with their alignment status."""
    both = own.join(reference, "month", "full_outer")
    has_own, has_ref = F.col("own_index").isNotNull(), F.col("reference_index").isNotNull()
    return both.withColumn(
        "status", F.when(has_own & has_ref, "ALIGNED").when(has_own, "PROJECT_ONLY").otherwise("MOSPI_REFERENCE")
    )


def rebase_months(aligned: DataFrame) -> DataFrame:
    """Both series at 100 in the last common month, two places."""
    last = aligned.filter("status = 'ALIGNED'").agg(
        F.max_by(F.struct("month", "own_index", "reference_index"), "month")
    ).scalar()

    def rebased(name):
        base = F.col(f"_r.{name}")
        return F.when(base > 0, F.bround(F.try_divide(F.col(name), base) * 100.0, 2))

    return aligned.withColumn("_r", last).select(
        *aligned.columns, F.col("_r.month").alias("reference_month"), rebased("own_index").alias("own_rebased"),
        rebased("reference_index").alias("reference_rebased"),
    )


def month_comparison(aligned: DataFrame) -> DataFrame:
    """One row for the last common month: level and percent difference, month-over-month moves, correlation."""
    common = aligned.filter("status = 'ALIGNED'")
    order = Window.orderBy("month")  # one row per month
    moves = common.withColumns(
        {
            "own_mom": F.bround((F.try_divide("own_index", F.lag("own_index").over(order)) - 1.0) * 100.0, 2),
            "reference_mom": F.bround((F.try_divide("reference_index", F.lag("reference_index").over(order)) - 1.0) * 100.0, 2),
        }
    )
    spread = F.stddev_pop("own_index") * F.stddev_pop("reference_index")
    r = F.when(spread > 0, F.try_divide(F.covar_pop("own_index", "reference_index"), spread)).otherwise(0.0)
    fields = F.struct("month", "own_index", "reference_index", "own_mom", "reference_mom")
    one = moves.agg(
        F.count(F.lit(1)).alias("overlapping_months"),
        F.when(F.count(F.lit(1)) >= 3, F.bround(r, 4)).alias("correlation"),
        F.max_by(fields, "month").alias("l"),
    )
    own, ref = F.col("l.own_index"), F.col("l.reference_index")
    n = F.col("overlapping_months")
    return one.select(
        "overlapping_months", F.col("l.month").alias("reference_month"), own.alias("own_index"), ref.alias("reference_index"),
        F.bround(F.abs(own - ref), 4).alias("absolute_difference"),
        F.bround(F.try_divide(own - ref, ref) * 100.0, 2).alias("percentage_difference"),
        F.col("l.own_mom").alias("own_mom"), F.col("l.reference_mom").alias("reference_mom"),
        F.bround(F.abs(F.col("l.own_mom") - F.col("l.reference_mom")), 2).alias("mom_difference"),
        "correlation",
        F.when(n >= 3, "CONNECTED").otherwise("INSUFFICIENT_OVERLAP").alias("correlation_status"),
        F.when(n == 1, "Absolute Level Difference").otherwise("Mean Absolute Error (MAE)").alias("difference_label"),
    )


def overlay_months(results: DataFrame, reference: DataFrame, window: str = K.HEADLINE_WINDOW) -> DataFrame:
    """Daily points of one window beside the reference value of their month, two places."""
    used = results.filter((F.col("booking_window") == window) & (F.col("status") == "SUCCESS") & F.col("index_value").isNotNull())
    return used.withColumn("month", month_key()).join(reference, "month", "left").select(
        "observation_date", F.bround(F.col("index_value").cast("double"), 2).alias("calculated_index"),
        F.bround("reference_index", 2).alias("reference_index"),
    )


def daily_volatility(results: DataFrame, window: str | None = None, date: str = "observation_date") -> DataFrame:
    """Sample deviation of the daily percent changes per window, as a number and as text with two places."""
    used = results.filter((F.col("status") == "SUCCESS") & F.col("index_value").isNotNull())
    if window is not None:
        used = used.filter(F.col("booking_window") == window)
    w = Window.partitionBy("booking_window").orderBy(date)
    value = F.col("index_value").cast("double")
    before = F.lag(value).over(w)
    rows = used.withColumn("_change", F.try_divide(value - before, before) * 100)
    return rows.groupBy("booking_window").agg(F.coalesce(F.stddev_samp("_change"), F.lit(0.0)).alias("volatility")).withColumn(
        "volatility_text", F.format_string("%.2f", "volatility")
    ).withColumn("status", F.when(F.col("volatility_text").cast("double") < 5.0, "STABLE").otherwise("VOLATILE"))


def corridor_coverage(route_indices: DataFrame, window: str = K.HEADLINE_WINDOW, results: DataFrame | None = None) -> DataFrame:
    """Share of SUCCESS routes of one window behind its latest SUCCESS result.

    ``results`` names the calculations; the route rows of the latest successful one count, not those of other runs of
    its date. Without it the routes are those of a single calculation and its latest date counts.
    """
    rows = route_indices.filter(F.col("booking_window") == window)
    if results is not None:
        good = results.filter((F.col("status") == "SUCCESS") & (F.col("booking_window") == window))
        chosen = good.agg(F.max_by("calculation_version", F.struct("observation_date", "calculation_timestamp"))).scalar()
        rows = rows.filter(F.col("calculation_version") == chosen)
    per_day = rows.groupBy("observation_date").agg(
        (F.avg((F.col("status") == "SUCCESS").cast("double")) * 100.0).alias("coverage_percent")
    )
    latest = per_day.agg(F.max_by(F.struct("observation_date", "coverage_percent"), "observation_date").alias("l")).select("l.*")
    shown = F.concat(F.format_string("%.1f", "coverage_percent"), F.lit("%"))
    return latest.withColumn("coverage_text", shown).withColumn(
        "status", F.when(F.col("coverage_text") == "100.0%", "OPTIMAL").otherwise("PARTIAL")
    )
