"""Comparable-pair matching.

Every quote is emitted once as a current and once as a previous price; one aggregation by (date, product) then yields
the lowest fare of both sides. Copies and sources collapse before the shuffle, no join is needed and a product quoted
very often is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import finite
from ..functions.fingerprints import pairing_fingerprint, shown_fingerprint

SLICE = ["observation_date", "route", "booking_window"]


def eligible_fare(allow_suspect: bool = False) -> Column:
    """The fare when it may enter a pair, else null."""
    dropped = ["EXCLUDED"] if allow_suspect else ["EXCLUDED", "SUSPECT"]
    fare = finite(F.col("comparable_fare"))
    return F.when((fare > 0) & ~F.col("quality_status").isin(*dropped), fare)


def _priced(observations: DataFrame, include_travel_date: bool, allow_suspect: bool) -> DataFrame:
    return observations.select(
        *SLICE,
        pairing_fingerprint(include_travel_date, digits=64).alias("fingerprint"),
        eligible_fare(allow_suspect).alias("fare"),
    )


def _both_sides(tagged: DataFrame) -> DataFrame:
    """Aggregate tagged quotes to one row per (date, product). Products are told apart by the whole digest, then shown by its first digits."""
    current, previous = F.col("is_current"), ~F.col("is_current")
    return tagged.groupBy(*SLICE, "fingerprint").agg(
        F.min(F.when(current, F.col("fare"))).alias("current_fare"),
        F.min(F.when(previous, F.col("fare"))).alias("previous_fare"),
        F.count_if(current & F.col("fare").isNotNull()).alias("current_quotes"),
        F.count_if(previous & F.col("fare").isNotNull()).alias("previous_quotes"),
        F.count_if(current).alias("current_raw"),
        F.count_if(previous).alias("previous_raw"),
    ).withColumn("fingerprint", shown_fingerprint(F.col("fingerprint")))


def consecutive_products(
    observations: DataFrame, include_travel_date: bool = False, allow_suspect: bool = False
) -> DataFrame:
    """Products of every date t with the prices of t and t-1, for all dates at once."""
    sides = F.explode(
        F.array(
            F.struct(F.col("observation_date").alias("day"), F.lit(True).alias("is_current")),
            F.struct(F.date_add("observation_date", 1).alias("day"), F.lit(False).alias("is_current")),
        )
    )
    tagged = _priced(observations, include_travel_date, allow_suspect).select(
        sides.alias("side"), "route", "booking_window", "fingerprint", "fare"
    )
    return _both_sides(
        tagged.select(
            F.col("side.day").alias("observation_date"), "route", "booking_window", "fingerprint", "fare", "side.is_current"
        )
    )


def two_day_products(
    current: DataFrame, previous: DataFrame, observation_date: Column, include_travel_date: bool = False,
    allow_suspect: bool = False,
) -> DataFrame:
    """Products of two given batches, dated with the current date."""
    def side(df, flag):
        priced = _priced(df, include_travel_date, allow_suspect)
        return priced.withColumn("observation_date", observation_date).withColumn("is_current", F.lit(flag))

    return _both_sides(side(current, True).unionByName(side(previous, False)))


def matched_pairs(products: DataFrame) -> DataFrame:
    """Inner pairs with their price relative; pairs without a finite positive relative are dropped."""
    relative = finite(F.try_divide("current_fare", "previous_fare"))
    return (
        products.withColumn("relative", relative)
        .filter("current_fare > 0 and previous_fare > 0 and relative > 0")
        .select(*SLICE, "fingerprint", "current_fare", "previous_fare", "relative")
    )


def invalid_pairs(products: DataFrame) -> DataFrame:
    """Matched products whose relative overflows or underflows, with a warning text."""
    relative = finite(F.try_divide("current_fare", "previous_fare"))
    return products.filter("current_fare is not null and previous_fare is not null").filter(
        relative.isNull() | (relative <= 0)
    ).withColumn("warning", F.concat(F.lit("Invalid fare values for pair "), F.col("fingerprint")))


def pairing_diagnostics(products: DataFrame) -> DataFrame:
    """Matched, unmatched and duplicate counts per slice."""
    has_current, has_previous = F.col("current_fare").isNotNull(), F.col("previous_fare").isNotNull()
    return products.groupBy(*SLICE).agg(
        F.count_if(has_current & has_previous).alias("matched"),
        F.count_if(has_current & ~has_previous).alias("unmatched_current"),
        F.count_if(~has_current & has_previous).alias("unmatched_previous"),
        F.count_if((F.col("current_quotes") > 1) | (F.col("previous_quotes") > 1)).alias("duplicate_fingerprints"),
    )


def duplicate_fingerprints(products: DataFrame) -> DataFrame:
    """The products quoted more than once on either side, as rows (their number is not bounded)."""
    return products.filter("current_quotes > 1 or previous_quotes > 1").select(
        *SLICE, "fingerprint", "current_quotes", "previous_quotes"
    )
