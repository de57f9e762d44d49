"""Scans of raw quotes, itineraries and stored observations; the search grid."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import fares, text
from ..schemas import ITINERARY, RAW_QUOTES
from ..operators.cleaning import IDENTITY_TEXT, build_observations, of_days


def read_raw_quotes(
    spark: SparkSession, path: str, file_format: str = "parquet", schema: str = RAW_QUOTES, start: str | None = None, end: str | None = None,
    sources: Sequence[str] = (),
) -> DataFrame:
    """Raw quotes in the canonical layout; the schema is given, never inferred. Days and sources are handed to the scan (``of_days``)."""
    raw = spark.read.schema(schema).format(file_format).load(path)
    return complete_raw(raw if start is None and not sources else of_days(raw, start or "0001-01-01", end or "9999-12-30", sources))


def complete_raw(df: DataFrame) -> DataFrame:
    """Components from the total where the base is missing, and a content id."""
    base, taxes, charges = fares.split_total(
        F.col("total_fare"), F.col("base_fare"), F.col("taxes"), F.col("mandatory_charges"), tolerance=None
    )
    stamp = F.date_format("observation_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    identity = F.concat_ws(
        "|", F.concat_ws("-", "origin", "destination"), shown("travel_date"), shown("airline"), shown("flight_number"),
        shown("departure_time"), shown("booking_window"), shown("source"), stamp,
    )
    rows = df.withColumns({"base_fare": base, "taxes": taxes, "mandatory_charges": charges})
    given = F.col("observation_id") if "observation_id" in df.columns else F.lit(None).cast("string")
    return rows.withColumn("observation_id", F.coalesce(F.nullif(given, F.lit("")), F.sha2(identity, 256)))


def flatten_itineraries(df: DataFrame, column: str = "itinerary") -> DataFrame:
    """Raw quotes from itinerary JSON beside origin, destination, travel_date, observation_date, booking_window and
    observation_timestamp; itineraries without a segment, an amount or a readable departure are dropped."""
    known = lambda c, other: F.coalesce(c, F.lit(other))
    parsed = text.evaluate_once(df, *[c for c in df.columns if c != column], F.from_json(F.col(column), ITINERARY).alias("j"))
    first = F.get(F.col("j.outbound.segments"), F.lit(0).cast("int"))
    rows = parsed.withColumn("s", first).withColumn("departs", F.col("s.departure_time_local").try_cast("timestamp"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    bags = F.col("j.bags")
    return rows.filter("s is not null and j.price.amount is not null and departs is not null").select(
        *[c for c in df.columns if c != column],
        known(F.coalesce("j.outbound.carrier", "s.operating_carrier_name"), "UNKNOWN").alias("airline"),
        known(F.col("s.flight_number"), "UNKNOWN").alias("flight_number"),
        F.date_format("departs", "HH:mm").alias("departure_time"),
        F.upper(known(F.col("j.cabin_class"), "UNKNOWN")).alias("cabin_class"),
        F.lit("UNKNOWN").alias("fare_type"),
        F.when(bags.isNull() | bags.isin("", "{}", "[]"), "NOT_SPECIFIED").otherwise(bags).alias("baggage_characteristics"),
        F.col("j.price.amount").alias("total_fare"),
        known(F.col("j.price.currency"), "INR").alias("currency"),
        F.lit("ignav").alias("source"),
        F.create_map(
            F.lit("ignav_id"), shown("j.ignav_id"), F.lit("price_status"), shown("j.price.status"),
            F.lit("requires_self_transfer"), F.coalesce(F.col("j.requires_self_transfer").cast("string"), F.lit("false")),
            F.lit("duration_minutes"), shown("j.outbound.duration_minutes"),
            F.lit("marketing_carrier_code"), shown("s.marketing_carrier_code"),
            F.lit("operating_carrier_name"), shown("s.operating_carrier_name"),
            F.lit("departure_timezone"), shown("s.departure_timezone"), F.lit("arrival_airport"), shown("s.arrival_airport"),
            F.lit("arrival_time_local"), shown("s.arrival_time_local"), F.lit("aircraft"), shown("s.aircraft"),
        ).alias("metadata"),
    )


def bridge_records(df: DataFrame) -> DataFrame:
    """Collected records as cleaning input: 'T+n' windows, 'HH:mm' times, a derived observation date, and components
    redistributed when the base is missing or their sum is off."""
    window = F.col("booking_window").cast("string")
    days = window.try_cast("int")
    base, taxes, charges = fares.split_total(F.col("total_fare"), F.col("base_fare"), F.col("taxes"), F.col("mandatory_charges"))
    clock = F.regexp_extract(F.col("departure_time").cast("string"), r"^(\d{2}:\d{2})(?::\d{2}(?:\.\d+)?)?$", 1)
    return df.withColumns(
        {
            "observation_date": F.coalesce("observation_date", F.date_sub("travel_date", days)),
            "booking_window": F.when(days.isNotNull(), F.concat(F.lit("T+"), days.cast("string"))).otherwise(window),
            "departure_time": F.when(clock != "", clock).otherwise(F.col("departure_time").cast("string")),
            "base_fare": base, "taxes": taxes, "mandatory_charges": charges,
        }
    )


def directed_routes(cities: DataFrame, city: str = "city") -> DataFrame:
    """Ordered pairs of distinct cities. The list of cities is a small configured table."""
    codes = cities.agg(F.array_sort(F.collect_set(city))).scalar()
    return (
        cities.select(F.col(city).alias("origin")).distinct()
        .withColumn("destination", F.explode(codes))
        .filter("origin <> destination")
        .withColumn("route", F.concat_ws("-", "origin", "destination"))
    )


def search_grid(routes: DataFrame, observation_date: Column, lead_days: Sequence[int] = K.WINDOW_DAYS) -> DataFrame:
    """The searches of a collection run: routes by windows with their travel dates."""
    days = F.explode(F.array(*[F.lit(d) for d in lead_days]))
    return routes.withColumn("observation_date", observation_date).withColumn("lead_days", days).withColumn(
        "travel_date", F.date_add("observation_date", F.col("lead_days"))
    )


def deserialize_observations(df: DataFrame) -> DataFrame:
    """Observations from text columns: ISO dates and timestamps, window text, defaults for absent fields."""
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    stamp = F.col("observation_timestamp").try_cast("timestamp")
    typed = df.withColumns(
        {
            "travel_date": F.col("travel_date").try_cast("date"),
            "observation_date": F.col("observation_date").try_cast("date"),
            "observation_timestamp": stamp,
            "comparable_fare": text.to_number(F.col("comparable_fare")),
            "quality_status": F.upper(known("quality_status", "VALID")),
            **{c: known(c, "") for c in IDENTITY_TEXT},
        }
    )
    return build_observations(text.evaluate_once(typed, *typed.columns))


def read_stored_observations(spark: SparkSession, path: str, observation_date: str, source: str, valid_only: bool = True) -> DataFrame:
    """Stored observations of one date and source as index rows; only that date's partition is read."""
    stored = spark.read.parquet(path).filter(
        (F.col("observation_date") == F.lit(observation_date).cast("date")) & (F.col("source") == source)
        & (F.col("quality_status") != "EXCLUDED")
    )
    return stored_to_observations(stored, valid_only)


def stored_to_observations(stored: DataFrame, valid_only: bool = True) -> DataFrame:
    """Index rows of stored observations; rows that break a rule are left out."""
    rows = stored.withColumns(
        {
            "origin": F.split("route", "-", 2)[0],
            "destination": F.get(F.split("route", "-", 2), F.lit(1)),
            "comparable_fare": F.col("comparable_fare").cast("double"),
            "quality_status": F.coalesce("quality_status", F.lit("VALID")),
            "metadata": F.from_json("metadata", "map<string,string>"),
        }
    )
    rows = build_observations(rows)
    return rows.filter("quality_status = 'VALID'") if valid_only else rows
