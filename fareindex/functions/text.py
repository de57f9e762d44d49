"""Text, number, window and route expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SOURCE_ALIASES, WINDOW_DAYS, WINDOWS

# Marks removed from a fare text, in this order.
CURRENCY_MARKS = ("₹", ",", "INR", "Rs.", "Rs")
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def literal_map(values: dict) -> Column:
    """A constant map; the optimizer folds it once per plan."""
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def evaluate_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select the columns and pin their values.

    Later filters and projections then read the results; the optimizer would otherwise copy long expressions into each
    of them.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def normalize_text(value: Column) -> Column:
    """Trim, collapse any whitespace, upper-case; null becomes the empty text."""
    spaced = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " ")
    return F.upper(F.trim(spaced))


def canonical_source(value: Column) -> Column:
    """Canonical source name, null for an unknown one."""
    return literal_map(SOURCE_ALIASES)[normalize_text(value)]


def is_known_source(value: Column) -> Column:
    return normalize_text(value).isin(*SOURCE_ALIASES)


def finite(value: Column) -> Column:
    """The number itself, null when NaN or infinite."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def parse_fare(value: Column) -> Column:
    """Fare text to a finite double; junk, blank and non-finite text become null, negatives stay."""
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    for mark in CURRENCY_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return finite(F.when(text.rlike(_NUMBER), digits.try_cast("double")))


def to_number(value: Column) -> Column:
    """Read-side coercion of a text column: blank, junk, NaN and infinite become null."""
    text = F.trim(value)
    return finite(F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double")))


def window_of_lead(lead_days: Column) -> Column:
    """Window label of an exact lead, null when the lead is unsupported."""
    return literal_map(dict(zip(WINDOW_DAYS, WINDOWS)))[lead_days.cast("int")]


def lead_of_window(window: Column) -> Column:
    return literal_map(dict(zip(WINDOWS, WINDOW_DAYS)))[window]


def parse_window(value: Column) -> Column:
    """'t+7', ' T_7 ', 'T + 7' to 'T+7'; anything else to null."""
    text = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    label = F.regexp_replace(text, "^T_", "T+")
    return F.when(label.isin(*WINDOWS), label)


def travel_date(observation_date: Column, lead_days: Column) -> Column:
    """Departure date of a supported lead, null for an unsupported one."""
    return F.when(lead_days.isin(*WINDOW_DAYS), F.date_add(observation_date, lead_days.cast("int")))


def valid_route(value: Column) -> Column:
    """Upper-cased 'AAA-BBB' with two different halves, otherwise null."""
    code = F.upper(value)
    shaped = code.rlike("^[A-Z]{3}-[A-Z]{3}$")
    return F.when(shaped & (F.substring(code, 1, 3) != F.substring(code, 5, 3)), code)
