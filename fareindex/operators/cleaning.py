"""Classification, normalization, duplicate and outlier marking."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import fares, text
from ..functions.fingerprints import identity_fingerprint
from .quantiles import exact_quantiles

IDENTITY_TEXT = ("airline", "flight_number", "departure_time", "cabin_class", "fare_type", "baggage_characteristics")
DUPLICATE_KEY = ("fingerprint", "observation_timestamp", "source")


def _first_reason(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """Reason of the first rule that holds, else null."""
    chain = None
    for condition, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        chain = F.when(condition, reason) if chain is None else chain.when(condition, reason)
    return chain


def _fares_of(df: DataFrame) -> dict[str, Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {
        name: fares.fare_number(F.col(name), types[name])
        for name in ("base_fare", "taxes", "mandatory_charges", "total_fare")
    }


def observation_day() -> Column:
    return F.coalesce(F.col("observation_date"), F.to_date("observation_timestamp"))


def lead_days(observation_date: Column, travel: Column) -> Column:
    return F.date_diff(travel, observation_date)


def is_positive_fare(value: Column, data_type=None) -> Column:
    return F.coalesce(fares.fare_number(value, data_type) > 0, F.lit(False))


def status_text_rules(status: Column) -> list[tuple[Column, str]]:
    return [
        (status == K.CANCELLED_TEXT, K.REASON_CANCELLED),
        (status.isin(*K.SOLD_OUT_TEXTS), K.REASON_SOLD_OUT),
        (status == K.UNAVAILABLE_TEXT, K.REASON_UNAVAILABLE),
    ]


def classify_status_text(value: Column) -> Column:
    """Struct (status, reason) of a status text; an unknown text is SUSPECT."""
    status = text.normalize_text(value)
    reason = _first_reason(status_text_rules(status))
    return (
        F.when(reason.isNotNull(), F.struct(F.lit("EXCLUDED").alias("status"), reason.alias("reason")))
        .when(status.isin(*K.AVAILABLE_TEXTS), F.struct(F.lit("VALID").alias("status"), F.lit("").alias("reason")))
        .otherwise(F.struct(F.lit("SUSPECT").alias("status"), status.alias("reason")))
    )


def missing_required_field() -> Column:
    """Reason of the first absent identity field, null when all are present."""
    blank = {n: text.normalize_text(F.col(n)) == "" for n in ("origin", "destination", "source")}
    return _first_reason(
        [
            (blank["origin"], "missing origin"),
            (blank["destination"], "missing destination"),
            (F.col("travel_date").isNull(), "missing travel date"),
            (blank["source"], "missing source"),
        ]
    )


def tidy(raw: DataFrame, keep_raw: bool = False, metadata: bool = True) -> DataFrame:
    """Clean texts and numbers of a raw row, each computed once; on demand the untouched row stays in ``_raw``.

    Without ``metadata`` that column is not read: the values are pinned, so the planner cannot leave out one that nobody uses later.
    """
    number = _fares_of(raw)
    kept = [F.col("ingest_seq")] if "ingest_seq" in raw.columns else []
    if keep_raw:
        kept.append(F.struct(*raw.columns).alias("_raw"))
    return text.evaluate_once(
        raw,
        *kept,
        F.col("source").alias("_source"),
        *[text.normalize_text(F.col(n)).alias(n) for n in ("origin", "destination", *IDENTITY_TEXT)],
        text.normalize_text(F.col("source")).alias("_source_text"),
        text.normalize_text(F.col("observation_status")).alias("_status_text"),
        "travel_date",
        observation_day().alias("observation_date"),
        lead_days(observation_day(), F.col("travel_date")).alias("lead_days"),
        *[number[n].alias(n) for n in ("base_fare", "taxes", "mandatory_charges", "total_fare")],
        *[F.col(n).isNull().alias(f"_no_{n}") for n in ("base_fare", "taxes", "mandatory_charges", "total_fare")],
        "observation_timestamp",
        F.col("metadata") if metadata else F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def of_days(raw: DataFrame, start, end, sources: Sequence[str] = ()) -> DataFrame:
    """Raw quotes of the observation days from start to end, and of canonical sources where some are named.

    Said here, before the cleaning, the filters reach the scan: they name the raw columns, so a table that is partitioned by
    ``observation_date`` or ``source`` reads those folders only, besides the one of quotes without a date, whose day is that of their time.
    """
    low, high = (F.lit(d).cast("date") for d in (start, end))
    day, time = F.col("observation_date"), F.col("observation_timestamp")
    until = F.date_add(high, 1).cast("timestamp")
    rows = raw.filter(day.between(low, high) | (day.isNull() & (time >= low.cast("timestamp")) & (time < until)))
    names = [a for a, c in K.SOURCE_ALIASES.items() if c in sources]
    return rows.filter(text.normalize_text(F.col("source")).isin(names)) if sources else rows


def _raw_rules() -> Column:
    """Reason of the first failing rule of a tidied raw row, null when it is acceptable."""
    bad = {n: ~F.coalesce(F.col(n) > 0, F.lit(False)) for n in ("base_fare", "taxes", "mandatory_charges", "total_fare")}
    rules = status_text_rules(F.col("_status_text"))
    rules += [
        (F.col("origin") == "", K.REASON_NO_ORIGIN),
        (F.col("destination") == "", K.REASON_NO_DESTINATION),
        (F.col("travel_date").isNull(), K.REASON_NO_TRAVEL_DATE),
        (F.col("lead_days") < 0, K.REASON_TRAVEL_BEFORE),
        (F.col("_source_text") == "", K.REASON_NO_SOURCE),
        (~F.col("_source_text").isin(*K.SOURCE_ALIASES), K.REASON_UNKNOWN_SOURCE),
        (F.col("airline") == "", K.REASON_NO_AIRLINE),
        (F.col("_no_base_fare"), K.REASON_NO_BASE),
        (bad["base_fare"], K.REASON_BAD_BASE),
        (F.col("_no_taxes"), K.REASON_NO_TAXES),
        (bad["taxes"], K.REASON_BAD_TAXES),
        (F.col("_no_mandatory_charges"), K.REASON_NO_CHARGES),
        (bad["mandatory_charges"], K.REASON_BAD_CHARGES),
        (~F.col("_no_total_fare") & bad["total_fare"], K.REASON_BAD_TOTAL),
    ]
    return _first_reason(rules)


def _normalization_error() -> Column:
    """Why a tidied row cannot be normalized, null when it can."""
    lead_error = F.concat(
        F.lit("Lead time of "), F.col("lead_days").cast("string"), F.lit(" days does not match a supported booking window. "
        "Expected one of: T+1, T+7, T+15, T+30, T+45."),
    )
    shown = F.coalesce(F.col("_source"), F.lit("None"))
    return _first_reason(
        [
            (F.col("travel_date").isNull(), "Travel date is required"),
            (F.col("observation_date").isNull(), "Observation date is required"),
            (F.col("origin") == "", "Origin is required"),
            (F.col("destination") == "", "Destination is required"),
            (F.col("origin") == F.col("destination"), K.REASON_SAME_CITY),
            (~F.col("_source_text").isin(*K.SOURCE_ALIASES), F.concat(F.lit("unknown source: "), shown)),
            (~F.coalesce(F.col("lead_days").isin(*K.WINDOW_DAYS), F.lit(False)), lead_error),
        ]
    )


def _excluded_reason() -> Column:
    status = F.col("_status_text")
    fare = fares.comparable_fare(*[F.col(n) for n in ("base_fare", "taxes", "mandatory_charges", "total_fare")])
    return F.when(status.isin(K.CANCELLED_TEXT, *K.SOLD_OUT_TEXTS, K.UNAVAILABLE_TEXT), status).when(
        fare.isNull(), K.REASON_MISSING_FARE
    )


def classify(raw: DataFrame) -> DataFrame:
    """The raw rows with ``raw_status`` and ``raw_reason`` by the ordered rules for raw quotes."""
    checked = tidy(raw, keep_raw=True).select("_raw", F.coalesce(_raw_rules(), F.lit("")).alias("raw_reason"))
    return checked.select(
        "_raw.*", "raw_reason", F.when(F.col("raw_reason") == "", "VALID").otherwise("EXCLUDED").alias("raw_status")
    )


def normalize_tidy(rows: DataFrame) -> DataFrame:
    """Normalized columns of tidied rows plus ``normalize_error`` (null when the row could be normalized)."""
    fare = fares.comparable_fare(*[F.col(n) for n in ("base_fare", "taxes", "mandatory_charges", "total_fare")])
    reason = F.coalesce(_excluded_reason(), F.lit(""))
    # The four keys added to the metadata of a normalized row.
    added = F.create_map(
        F.lit("canonical_source"), F.coalesce(text.literal_map(K.SOURCE_ALIASES)[F.col("_source_text")], F.lit("")),
        F.lit("lead_days"), F.coalesce(F.col("lead_days").cast("string"), F.lit("")),
        F.lit("quality_reason_code"), reason,
        F.lit("observation_status"), F.col("_status_text"),
    )
    own_keys = F.map_filter(
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("canonical_source", "lead_days", "quality_reason_code", "observation_status"),
    )
    kept = [c for c in ("ingest_seq", "_raw", "reject_reason") if c in rows.columns]
    return rows.select(
        *kept,
        "origin", "destination", F.concat_ws("-", "origin", "destination").alias("route"), "travel_date",
        "observation_date", "lead_days", text.window_of_lead(F.col("lead_days")).alias("booking_window"), *IDENTITY_TEXT,
        "base_fare", "taxes", "mandatory_charges", fare.alias("comparable_fare"),
        text.literal_map(K.SOURCE_ALIASES)[F.col("_source_text")].alias("source"),
        "observation_timestamp",
        identity_fingerprint(normalized=True).alias("fingerprint"),
        F.when(reason == "", "VALID").otherwise("EXCLUDED").alias("quality_status"),
        reason.alias("quality_reason"),
        F.map_concat(own_keys, added).alias("metadata"),
        _normalization_error().alias("normalize_error"),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Normalization alone, without the raw rules; ``normalize_error`` names the obstacle."""
    return normalize_tidy(tidy(raw))


def assess(raw: DataFrame, keep_raw: bool = False, metadata: bool = True) -> DataFrame:
    """Tidied rows with ``reject_reason`` (null when accepted); one narrow stage."""
    reason = F.coalesce(_raw_rules(), _normalization_error(), _excluded_reason())
    return tidy(raw, keep_raw, metadata).withColumn("reject_reason", reason)


def accepted(raw: DataFrame, metadata: bool = True) -> DataFrame:
    """Normalized rows of the accepted quotes."""
    good = assess(raw, metadata=metadata).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return normalize_tidy(good).drop("normalize_error")


def rejected(raw: DataFrame) -> DataFrame:
    """Raw rows that fail, unchanged but for the reason put in their metadata."""
    bad = assess(raw, keep_raw=True).filter(F.col("reject_reason").isNotNull()).select("_raw.*", "reject_reason")
    own = F.map_filter(
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("quality_status", "quality_reason"),
    )
    note = F.create_map(F.lit("quality_status"), F.lit("EXCLUDED"), F.lit("quality_reason"), F.col("reject_reason"))
    return bad.withColumn("metadata", F.map_concat(own, note))


# ---------------------------------------------------------------- duplicates


def first_copies(df: DataFrame) -> DataFrame:
    """One row per duplicate key: kept sequence number, its fare and day, number of copies.

    Copies are combined before the shuffle, so a key that holds a large share of the rows is no hot spot.
    """
    return df.groupBy(*DUPLICATE_KEY).agg(
        F.min("ingest_seq").alias("first_seq"),
        F.count(F.lit(1)).alias("copies"),
        F.min_by("comparable_fare", "ingest_seq").alias("first_fare"),
        F.min_by("observation_date", "ingest_seq").alias("first_day"),
    )


# Always true for accepted rows. Stated by both users of ``first_copies``, so that their aggregations are equal and Spark
# computes and shuffles them once.
_COMPLETE = "fingerprint is not null and source is not null and first_seq is not null and first_day is not null and first_fare is not null"


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys seen more than once, with the sequence number that is kept."""
    return first_copies(df).filter(_COMPLETE).filter("copies > 1")


def kept_fares(df: DataFrame) -> DataFrame:
    """Day and fare of the first copies: the VALID rows that outlier bounds are taken from."""
    return first_copies(df).filter(_COMPLETE).filter("copies >= 1").select(
        F.col("first_day").alias("observation_date"), F.col("first_fare").alias("comparable_fare")
    )


def _same_key() -> Column:
    """Equality of duplicate keys. Fingerprint and source of an accepted row are never null; the timestamp may be, and null equals null."""
    return (
        (F.col("fingerprint") == F.col("_k_fingerprint")) & (F.col("source") == F.col("_k_source"))
        & F.col("observation_timestamp").eqNullSafe(F.col("_k_observation_timestamp"))
    )


def mark_duplicates(df: DataFrame, keys: DataFrame | None = None, among: Column | None = None) -> DataFrame:
    """Later copies become EXCLUDED and stay in the table; the first by ``ingest_seq`` is kept.

    The join side holds repeated keys only; adaptive execution broadcasts it when small and splits a skewed key. ``among``
    states which rows take part; the others pass unchanged.
    """
    keys = duplicate_keys(df if among is None else df.filter(among)) if keys is None else keys
    late = F.coalesce(F.col("ingest_seq") > F.col("first_seq"), F.lit(False))
    k = keys.select(*[F.col(c).alias(f"_k_{c}") for c in DUPLICATE_KEY], "first_seq")
    joined = df.join(k, _same_key() if among is None else among & _same_key(), "left").withColumn("_late", late)
    own = F.map_filter(F.col("metadata"), lambda k, v: k != "quality_reason_code")
    noted = F.map_concat(own, F.create_map(F.lit("quality_reason_code"), F.lit("DUPLICATE")))
    return joined.select(
        *[F.col(c) for c in df.columns if c not in ("quality_status", "quality_reason", "metadata")],
        F.when(F.col("_late"), "EXCLUDED").otherwise(F.col("quality_status")).alias("quality_status"),
        F.when(F.col("_late"), K.REASON_DUPLICATE).otherwise(F.col("quality_reason")).alias("quality_reason"),
        F.when(F.col("_late"), noted).otherwise(F.col("metadata")).alias("metadata"),
    )


def find_duplicates(df: DataFrame) -> DataFrame:
    """The later copies themselves."""
    keys = duplicate_keys(df).select(*[F.col(c).alias(f"_k_{c}") for c in DUPLICATE_KEY], "first_seq")
    return df.join(keys, _same_key()).filter("ingest_seq > first_seq").select(*df.columns)


def count_duplicates(df: DataFrame, *by: str) -> DataFrame:
    """Number of later copies, without shuffling rows again (copies - 1 per repeated key)."""
    counted = df.groupBy(*DUPLICATE_KEY, *by).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return counted.groupBy(*by).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))


def already_present(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose duplicate key is in the other table."""
    return df.join(existing.select(*[F.col(c).alias(f"_k_{c}") for c in DUPLICATE_KEY]), _same_key(), "left_semi").select(*df.columns)


# ------------------------------------------------------------------ outliers


def iqr_bounds(
    df: DataFrame, group_cols: Sequence[str] = ("observation_date",), multiplier: float = 1.5, minimum: int = 4,
    value: str = "comparable_fare",
) -> DataFrame:
    """Lower and upper bound per batch over positive values; groups with too few values get none."""
    if multiplier < 0:
        raise ValueError("multiplier cannot be negative")
    by_day = tuple(group_cols) == ("observation_date",)
    spread = exact_quantiles(
        df.filter(F.col(value) > 0), group_cols, value, {"q1": 0.25, "q3": 0.75}, few_groups=by_day
    )
    iqr = F.col("q3") - F.col("q1")
    return spread.filter(F.col("n_values") >= minimum).select(
        *group_cols, "n_values", "q1", "q3",
        (F.col("q1") - multiplier * iqr).alias("lower_bound"),
        (F.col("q3") + multiplier * iqr).alias("upper_bound"),
    )


def mark_outliers(
    df: DataFrame, group_cols: Sequence[str] = ("observation_date",), multiplier: float = 1.5, mark: bool = True,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """VALID rows outside the bounds of their batch become OUTLIER (or get ``is_outlier`` only)."""
    if bounds is None:
        bounds = iqr_bounds(df.filter("quality_status = 'VALID'"), group_cols, multiplier)
    bounds = bounds.select(*group_cols, "lower_bound", "upper_bound")
    # One row per calendar day is small by construction; other groupings are left to the planner.
    side = F.broadcast(bounds) if tuple(group_cols) == ("observation_date",) else bounds
    fare = F.col("comparable_fare")
    outside = (F.col("quality_status") == "VALID") & (fare > 0) & (
        (fare < F.col("lower_bound")) | (fare > F.col("upper_bound"))
    )
    joined = df.join(side, list(group_cols), "left").withColumn("is_outlier", F.coalesce(outside, F.lit(False)))
    if not mark:
        return joined.select(*df.columns, "is_outlier")
    return joined.select(
        *[c for c in df.columns if c not in ("quality_status", "quality_reason")],
        F.when(F.col("is_outlier"), "OUTLIER").otherwise(F.col("quality_status")).alias("quality_status"),
        F.when(F.col("is_outlier"), K.REASON_OUTLIER).otherwise(F.col("quality_reason")).alias("quality_reason"),
    )


# ------------------------------------------------------------------ composed


@dataclass(frozen=True)
class Cleaned:
    """Accepted rows (VALID, EXCLUDED copies, OUTLIER) and rejected raw rows with their reason."""

    observations: DataFrame
    rejected: DataFrame


def clean(raw: DataFrame, multiplier: float = 1.5) -> Cleaned:
    """Reject, normalize, mark duplicates, then mark outliers among the rows still VALID."""
    slim = accepted(raw, metadata=False)  # for keys and bounds
    # Every accepted row is VALID until here, so the first copies are exactly the rows the bounds are taken from.
    bounds = iqr_bounds(kept_fares(slim), multiplier=multiplier)
    return Cleaned(mark_outliers(mark_duplicates(accepted(raw), duplicate_keys(slim)), bounds=bounds), rejected(raw))


REJECTED = "REJECTED"


def assessed(raw: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Every raw row once: its normalized columns, ``quality_status`` (VALID, EXCLUDED copy, OUTLIER or REJECTED), ``quality_reason``, and
    the untouched row of a rejected quote in ``_raw``.

    What ``clean`` gives as two frames, with one pass over the quotes for the rows and one for the keys.
    """
    fine = F.col("reject_reason").isNull()
    rows = normalize_tidy(assess(raw, keep_raw=True)).drop("normalize_error")
    good = accepted(raw, metadata=False)  # for keys and bounds
    bounds = iqr_bounds(kept_fares(good), multiplier=multiplier)
    marked = mark_outliers(mark_duplicates(
        rows.withColumn("quality_status", F.when(fine, "VALID").otherwise(REJECTED)).withColumn("quality_reason", F.coalesce("reject_reason", F.lit(""))),
        duplicate_keys(good), fine), bounds=bounds)
    return marked.withColumn("_raw", F.when(~fine, F.col("_raw"))).drop("reject_reason")


def split_assessed(rows: DataFrame) -> Cleaned:
    """The two frames of ``clean`` from an assessed table, written or not."""
    own = F.map_filter(F.coalesce(F.col("_raw.metadata"), F.create_map().cast("map<string,string>")),
                       lambda k, v: ~k.isin("quality_status", "quality_reason"))
    note = F.create_map(F.lit("quality_status"), F.lit("EXCLUDED"), F.lit("quality_reason"), F.col("quality_reason"))
    lost = rows.filter(F.col("quality_status") == REJECTED)
    return Cleaned(rows.filter(F.col("quality_status") != REJECTED).drop("_raw"),
                   lost.select("_raw", F.col("quality_reason").alias("reject_reason"), F.map_concat(own, note).alias("_m"))
                   .select("_raw.*", "reject_reason", "_m").withColumn("metadata", F.col("_m")).drop("_m"))


def assessed_counts(rows: DataFrame, by: str = "observation_date") -> DataFrame:
    """Total, valid, excluded and outlier counts per batch of an assessed table, in one aggregation."""
    status = F.col("quality_status")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(status == "VALID").alias("valid_count"),
        F.count_if(status.isin("EXCLUDED", REJECTED)).alias("excluded_count"), F.count_if(status == "OUTLIER").alias("outlier_count"),
    )


def cleaning_counts(result: Cleaned, by: str = "observation_date") -> DataFrame:
    """Total, valid, excluded and outlier counts per batch."""
    kept = result.observations.groupBy(by).agg(
        F.count(F.lit(1)).alias("accepted_rows"),
        F.count_if(F.col("quality_status") == "VALID").alias("valid_count"),
        F.count_if(F.col("quality_status") == "EXCLUDED").alias("marked_excluded"),
        F.count_if(F.col("quality_status") == "OUTLIER").alias("outlier_count"),
    )
    lost = result.rejected.groupBy(observation_day().alias(by)).agg(F.count(F.lit(1)).alias("rejected_rows"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return kept.join(lost, by, "full_outer").select(
        by,
        (zero("accepted_rows") + zero("rejected_rows")).alias("total_processed"),
        zero("valid_count").alias("valid_count"),
        (zero("marked_excluded") + zero("rejected_rows")).alias("excluded_count"),
        zero("outlier_count").alias("outlier_count"),
    )


def to_index_observations(normalized: DataFrame) -> DataFrame:
    """Rows the index may use: positive fare, known window, known status text."""
    known = F.col("quality_status").isin(*K.QUALITY_STATUSES)
    window = text.parse_window(F.col("booking_window"))
    return normalized.filter((finite_positive("comparable_fare")) & window.isNotNull()).select(
        "origin", "destination", F.concat_ws("-", "origin", "destination").alias("route"),
        "travel_date", "observation_date", window.alias("booking_window"), *IDENTITY_TEXT,
        F.col("comparable_fare").cast("double").alias("comparable_fare"), "source", "observation_timestamp",
        F.when(known, F.col("quality_status")).otherwise("EXCLUDED").alias("quality_status"), "metadata",
    )


def finite_positive(name: str) -> Column:
    return F.coalesce(fares.finite(F.col(name)) > 0, F.lit(False))


def index_ready(raw: DataFrame) -> DataFrame:
    """Clean, keep VALID rows, convert."""
    return to_index_observations(clean(raw).observations.filter("quality_status = 'VALID'"))


# -------------------------------------------------------------------- checks


def normalized_row_error() -> Column:
    """First violated rule of a normalized row, null when it is sound."""
    fare = F.col("comparable_fare")
    return _first_reason(
        [
            (F.coalesce(F.col("origin"), F.lit("")) == "", "missing origin"),
            (F.coalesce(F.col("destination"), F.lit("")) == "", "missing destination"),
            (F.col("origin") == F.col("destination"), "invalid route"),
            (F.col("travel_date").isNull(), "missing travel date"),
            (F.col("observation_date").isNull(), "missing observation date"),
            (F.col("travel_date") < F.col("observation_date"), "travel date before observation date"),
            (F.coalesce(F.col("source"), F.lit("")) == "", "missing source"),
            (~text.is_known_source(F.col("source")), K.REASON_UNKNOWN_SOURCE),
            (fare.isNull(), K.REASON_NO_BASE),
            (~finite_positive("comparable_fare"), K.REASON_INVALID_FARE),
            (F.coalesce(F.col("fingerprint"), F.lit("")) == "", "missing fingerprint"),
        ]
    )


# Column length limits and allowed windows of the stored tables.
LENGTHS = {
    "origin": (3, 3), "destination": (3, 3), "airline": (1, 20), "flight_number": (1, 30), "departure_time": (1, 20),
    "cabin_class": (1, 30), "fare_type": (1, 50), "baggage_characteristics": (1, 100), "source": (1, 80),
    "fingerprint": (1, 128),
}


def contract_violations() -> Column:
    """All violated limits of a row for the observation sink, as an array of texts."""
    found = []
    for name, (low, high) in LENGTHS.items():
        size = F.length(F.coalesce(F.col(name), F.lit("")))
        found.append(F.when((size < low) | (size > high), f"{name}: length"))
    for name in ("base_fare", "taxes", "mandatory_charges"):
        found.append(F.when(F.col(name) < 0, f"{name}: negative"))
    found.append(F.when(~finite_positive("comparable_fare"), "comparable_fare: not positive"))
    found.append(F.when(~F.coalesce(F.col("booking_window").isin(*K.WINDOWS), F.lit(False)), "booking_window: unknown"))
    found.append(F.when(F.col("observation_timestamp").isNull(), "observation_timestamp: missing"))
    return F.array_compact(F.array(*found))


def observation_row_error() -> Column:
    """First violated constructor rule of an index observation, null when it is sound."""
    origin, destination = F.upper(F.trim(F.col("origin"))), F.upper(F.trim(F.col("destination")))
    return _first_reason(
        [
            (F.coalesce(origin, F.lit("")) == "", "Origin cannot be empty"),
            (F.coalesce(destination, F.lit("")) == "", "Destination cannot be empty"),
            (origin == destination, "Origin and destination cannot be identical"),
            (text.parse_window(F.col("booking_window")).isNull(), "Unsupported booking window"),
            (fares.finite(F.col("comparable_fare")).isNull(), "Comparable fare must be a finite number"),
            (F.col("comparable_fare") <= 0, "Comparable fare must be strictly positive"),
            (F.col("travel_date").isNull(), "travel_date must be a date"),
            (F.col("observation_date").isNull(), "observation_date must be a date"),
            (F.col("travel_date") < F.col("observation_date"), "Travel date cannot be before observation date"),
            (~F.upper(F.col("quality_status")).isin(*K.QUALITY_STATUSES), "Unknown quality status"),
        ]
    )


def build_observations(df: DataFrame) -> DataFrame:
    """Trimmed, upper-cased observations that satisfy every constructor rule."""
    def tidy(name):
        return F.upper(F.trim(F.col(name)))

    checked = df.withColumn("_error", observation_row_error()).filter(F.col("_error").isNull())
    return checked.select(
        tidy("origin").alias("origin"), tidy("destination").alias("destination"),
        F.concat_ws("-", tidy("origin"), tidy("destination")).alias("route"),
        "travel_date", "observation_date", text.parse_window(F.col("booking_window")).alias("booking_window"),
        *[(F.col(n) if n == "departure_time" else tidy(n)).alias(n) for n in IDENTITY_TEXT],
        F.col("comparable_fare").cast("double").alias("comparable_fare"), "source", "observation_timestamp",
        F.upper(F.col("quality_status")).alias("quality_status"), "metadata",
    )
