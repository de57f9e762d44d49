"""Agreement of a calculated daily series with a reference series."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.local import small_table
from ..functions.text import finite

DIRECTION_TOLERANCE = 1e-7


def align_daily(
    calculated: DataFrame, reference: DataFrame, start: Column, end: Column, windows: Sequence[str] = K.WINDOWS,
    keep_missing: bool = False,
) -> DataFrame:
    """Both series on the calendar between two dates: (booking_window, observation_date, calculated, reference)."""
    session = calculated.sparkSession
    spine = small_table(session, [(w,) for w in windows], "booking_window string").withColumn(
        "observation_date", F.explode(F.sequence(start, end))
    )
    key = ["booking_window", "observation_date"]
    joined = spine.join(
        calculated.select(*key, F.col("index_value").cast("double").alias("calculated")), key, "left"
    ).join(reference.select(*key, F.col("index_value").cast("double").alias("reference")), key, "left")
    return joined if keep_missing else joined.filter("calculated is not null and reference is not null")


def clean_pairs(aligned: DataFrame, a: str = "calculated", b: str = "reference") -> DataFrame:
    """Pairs without NaN or infinite members."""
    return aligned.filter(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull())


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str]) -> DataFrame:
    """Fractional ranks, ties sharing their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's r clamped to ±1, null for fewer than two pairs or a constant series."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    r = F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))
    return F.when((F.count(F.lit(1)) >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _correlation_status(a: str, b: str) -> Column:
    return (
        F.when(F.count(F.lit(1)) < 2, "INSUFFICIENT_DATA")
        .when((F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0), "UNDEFINED_VARIANCE")
        .otherwise("VALID")
    )


def pearson(aligned: DataFrame, by: Sequence[str] = ("booking_window",)) -> DataFrame:
    return clean_pairs(aligned).groupBy(*by).agg(
        correlation("calculated", "reference").alias("value"),
        _correlation_status("calculated", "reference").alias("status"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def spearman(aligned: DataFrame, by: Sequence[str] = ("booking_window",)) -> DataFrame:
    ranked = average_ranks(average_ranks(clean_pairs(aligned), "calculated", "_rc", by), "reference", "_rr", by)
    return ranked.groupBy(*by).agg(
        correlation("_rc", "_rr").alias("value"), _correlation_status("_rc", "_rr").alias("status"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def mean_absolute_error(a: str = "calculated", b: str = "reference") -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def root_mean_squared_error(a: str = "calculated", b: str = "reference") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2)))


def _sign(change: Column) -> Column:
    return F.when(change > DIRECTION_TOLERANCE, 1).when(change < -DIRECTION_TOLERANCE, -1).when(change.isNotNull(), 0)


def _steps(aligned: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Changes between consecutive aligned points; calendar gaps do not matter."""
    w = Window.partitionBy(*by).orderBy(date)
    return aligned.withColumns(
        {f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in ("calculated", "reference")}
    )


def directional_accuracy(aligned: DataFrame, by: Sequence[str] = ("booking_window",), date: str = "observation_date") -> DataFrame:
    same = _sign(F.col("_d_calculated")) == _sign(F.col("_d_reference"))
    return _steps(clean_pairs(aligned), by, date).groupBy(*by).agg(
        F.avg(same.cast("double")).alias("value"),
        F.when(F.count(F.lit(1)) < 2, "INSUFFICIENT_DATA").otherwise("VALID").alias("status"),
        F.when(F.count(F.lit(1)) < 2, F.count(F.lit(1))).otherwise(F.count(same)).alias("sample_size"),
    )


def stability(aligned: DataFrame, by: Sequence[str] = ("booking_window",), date: str = "observation_date", value: str = "calculated") -> DataFrame:
    """Sample deviation of the first differences; needs three values."""
    w = Window.partitionBy(*by).orderBy(date)
    rows = aligned.filter(finite(F.col(value)).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(w))
    enough = F.count(F.lit(1)) >= 3
    return rows.groupBy(*by).agg(
        F.when(enough, F.stddev_samp("_d")).alias("value"),
        F.when(enough, "VALID").otherwise("INSUFFICIENT_DATA").alias("status"),
        F.when(enough, F.count("_d")).otherwise(F.count(F.lit(1))).alias("sample_size"),
    )


def temporal_coverage(matched: Column, expected: Column) -> Column:
    """Share of expected days, 0-1; null when nothing is expected."""
    return F.when(expected > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(matched, expected))))


def all_metrics(aligned: DataFrame, expected_days: Column, windows: Sequence[str] = K.WINDOWS, date: str = "observation_date") -> DataFrame:
    """Long table (booking_window, metric, value, status, sample_size, note), seven metrics per window."""
    by = ["booking_window"]
    finite_rows = clean_pairs(aligned)
    ranked = average_ranks(average_ranks(_steps(finite_rows, by, date), "calculated", "_rc", by), "reference", "_rr", by)
    n = F.count(F.lit(1))
    same = _sign(F.col("_d_calculated")) == _sign(F.col("_d_reference"))
    one = lambda value, status, size, note: F.struct(
        value.cast("double").alias("value"), status.alias("status"), size.cast("bigint").alias("sample_size"), note.alias("note")
    )
    some = F.when(n > 0, "VALID").otherwise("INSUFFICIENT_DATA")
    few = F.when(n < 2, "At least 2 valid paired observations required")

    def corr(a, b):
        status = _correlation_status(a, b)
        note = F.when(n < 2, few).when(status == "UNDEFINED_VARIANCE", "Zero variance detected: one or both series are constant").otherwise("")
        return one(correlation(a, b), status, n, note)

    three = n >= 3
    metrics = {
        "pearson_correlation": corr("calculated", "reference"),
        "spearman_correlation": corr("_rc", "_rr"),
        "mae": one(mean_absolute_error(), some, n, F.when(n == 0, "Zero valid pairs for MAE calculation").otherwise("")),
        "rmse": one(root_mean_squared_error(), some, n, F.when(n == 0, "Zero valid pairs for RMSE calculation").otherwise("")),
        "directional_accuracy": one(
            F.avg(same.cast("double")), F.when(n < 2, "INSUFFICIENT_DATA").otherwise("VALID"), F.when(n < 2, n).otherwise(F.count(same)),
            F.when(n < 2, "At least 2 points required to calculate direction of change").otherwise(""),
        ),
        "coverage": one(
            temporal_coverage(n, F.max("_days")), F.when(F.max("_days") > 0, "VALID").otherwise("INVALID_SERIES"), n, F.lit("")
        ),
        "stability": one(
            F.when(three, F.stddev_samp("_d_calculated")), F.when(three, "VALID").otherwise("INSUFFICIENT_DATA"),
            F.when(three, F.count("_d_calculated")).otherwise(n),
            F.when(three, "Sample standard deviation of first differences")
            .otherwise("At least 3 observations required to calculate change volatility"),
        ),
    }
    values = F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*metrics.values()))
    found = ranked.withColumn("_days", expected_days).groupBy(*by).agg(values.alias("m"))
    long = found.select("booking_window", F.explode("m").alias("metric", "r")).select("booking_window", "metric", "r.*")
    # Windows without one aligned day still report their seven metrics.
    session = aligned.sparkSession
    grid = small_table(session, [(w, m) for w in windows for m in metrics], "booking_window string, metric string")
    covered = F.col("metric") == "coverage"
    empty_note = (
        F.when(F.col("metric").isin("pearson_correlation", "spearman_correlation"), "At least 2 valid paired observations required")
        .when(F.col("metric") == "mae", "Zero valid pairs for MAE calculation")
        .when(F.col("metric") == "rmse", "Zero valid pairs for RMSE calculation")
        .when(F.col("metric") == "directional_accuracy", "At least 2 points required to calculate direction of change")
        .when(F.col("metric") == "stability", "At least 3 observations required to calculate change volatility")
        .otherwise("")
    )
    return grid.join(long, ["booking_window", "metric"], "left").select(
        "booking_window", "metric",
        F.when(F.col("status").isNull() & covered, 0.0).otherwise(F.col("value")).alias("value"),
        F.coalesce("status", F.when(covered, "VALID").otherwise("INSUFFICIENT_DATA")).alias("status"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        F.coalesce("note", empty_note).alias("note"),
    )


def backtest_summary(aligned: DataFrame, start: Column, end: Column, windows: Sequence[str] = K.WINDOWS) -> DataFrame:
    """Per window: matched and missing days, warning, and the status of the whole back-test."""
    days = F.date_diff(end, start) + 1
    session = aligned.sparkSession
    grid = small_table(session, [(w,) for w in windows], "booking_window string")
    counts = aligned.groupBy("booking_window").agg(F.count(F.lit(1)).alias("matched_days"))
    rows = grid.join(counts, "booking_window", "left").withColumn("matched_days", F.coalesce("matched_days", F.lit(0)))
    rows = rows.withColumn("expected_days", F.when(end < start, F.raise_error(F.lit("Invalid date range: start is after end"))).otherwise(days))
    best = F.max("matched_days").over(Window.partitionBy(F.lit(1)))  # five rows
    missing = F.col("expected_days") - F.col("matched_days")
    return rows.select(
        "booking_window", "expected_days", "matched_days",
        F.when(best >= F.col("expected_days") * 0.5, "COMPLETED").otherwise("LOW_DATA").alias("status"),
        F.when(
            missing > 0,
            F.concat(F.lit("["), F.col("booking_window"), F.lit("] Missing "), missing.cast("string"), F.lit(" dates out of "),
                     F.col("expected_days").cast("string"), F.lit(" expected days.")),
        ).alias("warning"),
    )
