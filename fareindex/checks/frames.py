"""Frames shared by the registered queries, all derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.local import small_table
from ..operators import cleaning, features, index as ix, signals
from ..plans import calculation, intelligence
from ..schemas import WEIGHTS
from ..sources import stores, testdata as td

WIDE = {"DEL-BOM": 0.29, "BOM-DEL": 0.22, "DEL-BLR": 0.14, "BLR-DEL": 0.12, "BOM-BLR": 0.06, "DEL-GOI": 0.17}


def wide_weights(spark: SparkSession) -> DataFrame:
    """A basket with one route that is never observed and without one that is."""
    return small_table(spark, [(r, w, "WIDE_V1", "USER_CONFIGURED", None, False, i) for i, (r, w) in enumerate(WIDE.items())], WEIGHTS)


def history(spark, sf, partial=True, wide=False):
    weights = wide_weights(spark) if wide else ix.demo_weights(spark)
    return calculation.historical_index(td.index_observations(spark, sf), weights, allow_partial=partial)


def prepared(spark, sf) -> intelligence.Prepared:
    """The tables that the signals start from."""
    return intelligence.prepare(td.index_observations(spark, sf), ix.demo_weights(spark))


def freshness(facts: DataFrame) -> DataFrame:
    """Age of each date's latest quote at the end of the day, in hours."""
    return signals.facts_days(facts).select(
        "observation_date", features.freshness_hours(F.col("latest"), F.date_add("observation_date", 1).cast("timestamp")).alias("freshness_hours"))


def _runs(df: DataFrame) -> DataFrame:
    """Every date in version A, every third day once more in version B, a little higher."""
    versions = F.when(F.dayofmonth("observation_date") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    rows = df.withColumn("_v", F.explode(versions))
    b = F.col("_v") == "B"
    hours = F.when(b, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    return rows.withColumns(
        {
            "calculation_version": F.concat(F.lit("CALC_"), F.col("observation_date").cast("string"), F.lit("_"), F.col("_v")),
            "calculation_timestamp": F.col("observation_date").cast("timestamp") + hours,
            "_f": F.when(b, F.lit(1.01)).otherwise(F.lit(1.0)),
        }
    )


def results(spark, sf) -> DataFrame:
    rows = _runs(history(spark, sf).national)
    return rows.select(
        "observation_date", "booking_window", F.bround(F.col("national_index") * F.col("_f"), 4).alias("index_value"), "status",
        "calculation_version", "calculation_timestamp", F.lit("none").alias("execution_checksum"),
    )


def route_results(spark, sf) -> DataFrame:
    run = history(spark, sf)
    key = ["observation_date", "booking_window", "route"]
    parts = run.contributions.select(*key, F.bround(F.coalesce("point_contribution", "level_contribution"), 4).alias("contribution"))
    rows = run.grid.select(*key, "index_value", "status").join(parts, key, "left").join(ix.demo_weights(spark).select("route", "weight"), "route", "left")
    return _runs(rows).select(
        "observation_date", "booking_window", "calculation_version", "route",
        F.bround(F.col("index_value") * F.col("_f"), 4).alias("index_value"), "status", "weight", "contribution", "calculation_timestamp",
    )


def routes(spark, sf) -> DataFrame:
    return stores.missing_routes(td.index_observations(spark, sf), small_table(spark, [], stores.ROUTES_SCHEMA))


def anomalies(spark, sf) -> DataFrame:
    rows = signals.detect_anomalies(history(spark, sf).grid.filter("index_value is not null"))
    return rows.withColumn("reason", F.when(F.col("detected"), signals.explanation()).otherwise(F.col("reason")))


def events(spark, sf) -> DataFrame:
    return signals.event_rows(anomalies(spark, sf)).withColumn("event_timestamp", F.col("observation_date").cast("timestamp"))


def confirmations(spark, sf) -> DataFrame:
    return signals.confirm_sources(signals.source_movements(signals.source_means(td.index_observations(spark, sf))))


def cleaned(spark, sf) -> cleaning.Cleaned:
    return cleaning.clean(td.flawed_quotes(spark, sf))


def assessed(spark, sf) -> DataFrame:
    return cleaning.assessed(td.flawed_quotes(spark, sf))


def long_results(spark, sf) -> DataFrame:
    return td.order_index(spark, sf).withColumn("status", F.lit("SUCCESS"))
