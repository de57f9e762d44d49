"""The two product identities: cleaning (with travel date) and pairing (with window and airline)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import normalize_text


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws("|", *parts)


def identity_fingerprint(
    origin="origin", destination="destination", travel_date="travel_date", flight_number="flight_number",
    departure_time="departure_time", cabin_class="cabin_class", fare_type="fare_type",
    baggage="baggage_characteristics", normalized: bool = False,
) -> Column:
    """64-hex identity of one physical fare; source is not part of it."""
    def text(name):
        return F.coalesce(F.col(name), F.lit("")) if normalized else normalize_text(F.col(name))

    parts = [text(origin), text(destination), F.coalesce(F.col(travel_date).cast("string"), F.lit(""))]
    parts += [text(n) for n in (flight_number, departure_time, cabin_class, fare_type, baggage)]
    return F.sha2(_joined(parts), 256)


SHOWN_DIGITS = 16  # fixed value: hex digits of the digest in an output


def pairing_fingerprint(include_travel_date: bool = False, digits: int = SHOWN_DIGITS) -> Column:
    """Route, window and the first hex digits of the digest of the constant-quality product; 64 are all."""
    names = ["route", "booking_window", "airline", "flight_number", "departure_time", "cabin_class", "fare_type",
             "baggage_characteristics"]
    parts = [F.coalesce(F.col(n), F.lit("")) for n in names]
    if include_travel_date:
        parts.append(F.col("travel_date").cast("string"))
    digest = F.substring(F.sha2(_joined(parts), 256), 1, digits)
    return F.concat_ws("_", F.col("route"), F.col("booking_window"), digest)


def shown_fingerprint(whole: Column) -> Column:
    """The output form of a fingerprint that has all 64 digits."""
    return F.left(whole, F.length(whole) - (64 - SHOWN_DIGITS))
