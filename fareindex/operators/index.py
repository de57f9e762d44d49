"""Elementary, route and national indices, contributions and weights."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import constants as K
from ..functions.local import small_table
from ..functions.text import finite
from ..schemas import WEIGHTS
from .pairing import SLICE, matched_pairs

SUCCESS, INSUFFICIENT = "SUCCESS", "INSUFFICIENT_DATA"


# ------------------------------------------------------------------- weights


def demo_weights(spark: SparkSession) -> DataFrame:
    """The illustrative, unofficial demo basket."""
    rows = [
        (route, weight, K.DEMO_WEIGHT_VERSION, K.DEMO_WEIGHT_SOURCE, None, False, i)
        for i, (route, weight) in enumerate(K.DEMO_WEIGHTS.items())
    ]
    return small_table(spark, rows, WEIGHTS)


def validate_weights(weights: DataFrame) -> DataFrame:
    """Per version: total, validity and the list of violated rules (an empty version has no row)."""
    w = F.col("weight")
    broken = F.isnan(w) | (F.abs(w) == F.lit(float("inf")))
    per_route = F.array_compact(
        F.array(
            F.when(w < 0, F.concat(F.lit("Route '"), F.col("route"), F.lit("' has negative weight"))),
            F.when(broken, F.concat(F.lit("Route '"), F.col("route"), F.lit("' has NaN or Infinite weight"))),
        )
    )
    total = F.sum("weight")
    off = ~(F.abs(total - 1.0) <= K.COVERAGE_TOLERANCE) & ~F.isnan(total)
    total_error = F.when(
        off, F.array(F.concat(F.lit("Weights do not sum to 1.0 (actual sum: "), F.format_string("%.6f", total), F.lit(")")))
    ).otherwise(F.array().cast("array<string>"))
    found = F.concat(total_error, F.flatten(F.array_sort(F.collect_list(per_route))))
    return (
        weights.groupBy("version")
        .agg(F.count(F.lit(1)).alias("routes"), total.alias("total_weight"), found.alias("errors"))
        .withColumn("is_valid", F.size("errors") == 0)
    )


def build_weights(raw: DataFrame, auto_normalize: bool = False) -> DataFrame:
    """Clean weight rows per version: percent totals to shares, tiny drift rescaled, off totals an error."""
    version = Window.partitionBy("version")
    rows = raw.withColumn("route", F.upper(F.trim("route"))).withColumn("weight", F.col("weight").cast("double"))
    bad = (
        F.when(~F.contains(F.col("route"), F.lit("-")), "Invalid route format")
        .when(finite(F.col("weight")).isNull(), "Weight cannot be NaN or Infinite")
        .when(F.col("weight") < 0, "Weight cannot be negative")
    )
    total = F.sum("weight").over(version)
    rows = rows.withColumn("_bad", bad).withColumn("_sum", total)
    if auto_normalize:
        rows = rows.withColumn("weight", F.try_divide("weight", "_sum")).withColumn("_total", F.sum("weight").over(version))
    else:
        percent = F.abs(F.col("_sum") - 100.0) < 1e-3
        rows = rows.withColumn("weight", F.when(percent, F.col("weight") / 100.0).otherwise(F.col("weight"))).withColumn(
            "_total", F.sum("weight").over(version)
        )
    error = F.coalesce(
        F.col("_bad"),
        F.when(~(F.col("_sum") > 0), "Total sum of route weights must be strictly positive"),
        F.when(F.abs(F.col("_total") - 1.0) > K.COVERAGE_TOLERANCE, "Route weights must sum to 1.0 (or 100%)"),
    )
    checked = F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.try_divide("weight", "_total"))
    return rows.withColumn("weight", checked.cast("double")).drop("_bad", "_sum", "_total")


def one_version(weights: DataFrame, version: str | None = None) -> DataFrame:
    """The rows of the chosen weight version. Without a choice the table must hold one version only.

    Weights are a configured table of some rows per version; its version names are read by the driver. An unknown version is an error.
    """
    if version is None and "version" not in weights.columns:  # a bare basket
        return weights
    found = sorted({str(r[0]) for r in weights.select("version").collect()})
    if version is not None:
        if version not in found:
            raise ValueError(f"the weight table has no version {version}; it holds {', '.join(found) or 'none'}")
        return weights.filter(F.col("version") == version)
    if len(found) > 1:
        raise ValueError(f"the weight table holds several versions ({', '.join(found)}); choose one")
    return weights


def route_weight(observed: DataFrame, weights: DataFrame, version: str | None = None) -> DataFrame:
    """Adds ``weight`` by route, 0 for a route outside the basket."""
    side = one_version(weights, version).select("route", "weight")
    return observed.join(side, "route", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


# ---------------------------------------------------------------- elementary


def jevons(relatives: DataFrame, by: Sequence[str], base_value: float = K.BASE_INDEX, relative: str = "relative") -> DataFrame:
    """Geometric mean of the finite positive relatives per group, scaled to the base."""
    r = finite(F.col(relative))
    usable = F.when(r > 0, r)
    return (
        relatives.groupBy(*by)
        .agg(F.exp(F.avg(F.ln(usable))).alias("geometric_mean"), F.count(usable).alias("valid_pairs"))
        .withColumn("index_value", F.col("geometric_mean") * base_value)
        .withColumn("status", F.when(F.col("valid_pairs") > 0, SUCCESS).otherwise(INSUFFICIENT))
    )


def elementary_slices(products: DataFrame, base_value: float = K.BASE_INDEX, min_pairs: int = 1) -> DataFrame:
    """Slice results straight from paired products: counts of raw quotes, pairs, index and status."""
    relative = finite(F.try_divide("current_fare", "previous_fare"))
    usable = F.when(relative > 0, relative)
    stats = products.groupBy(*SLICE).agg(
        F.exp(F.avg(F.ln(usable))).alias("geometric_mean"),
        F.count(usable).alias("num_matched_pairs"),
        F.sum("current_raw").alias("num_current_observations"),
        F.sum("previous_raw").alias("num_previous_observations"),
    )
    return _with_status(stats, base_value, min_pairs)


def _with_status(stats: DataFrame, base_value: float, min_pairs: int) -> DataFrame:
    pairs = F.coalesce("num_matched_pairs", F.lit(0))
    enough = pairs >= max(min_pairs, 1)
    few = F.concat(
        F.lit("Matched pairs count ("), pairs.cast("string"), F.lit(") is less than required minimum ("),
        F.lit(str(min_pairs)), F.lit(")"),
    )
    return stats.withColumns(
        {
            "geometric_mean": F.when(enough, F.col("geometric_mean")),
            "index_value": F.when(enough, F.col("geometric_mean") * base_value),
            "status": F.when(enough, SUCCESS).otherwise(INSUFFICIENT),
            "warnings": F.when(pairs < min_pairs, F.array(few)).otherwise(F.array().cast("array<string>")),
            "num_matched_pairs": pairs,
            "num_current_observations": F.coalesce("num_current_observations", F.lit(0)),
            "num_previous_observations": F.coalesce("num_previous_observations", F.lit(0)),
        }
    )


def calendar_transitions(slices: DataFrame) -> DataFrame:
    """Keep the dates that have quotes on both days, so that nothing is calculated across a gap."""
    day = Window.partitionBy("observation_date")
    return (
        slices.withColumn("_c", F.max("num_current_observations").over(day))
        .withColumn("_p", F.max("num_previous_observations").over(day))
        .filter("_c > 0 and _p > 0")
        .drop("_c", "_p")
    )


def route_grid(slices: DataFrame, windows: Sequence[str] = K.WINDOWS, min_pairs: int = 1) -> DataFrame:
    """Dense results: every route of a date in every target window, and the status of the route.

    The slices of a route are gathered (at most one per window) and laid out again, so the quotes are read once.
    """
    stats = [c for c in slices.columns if c not in (*SLICE, "index_value", "status", "warnings")]
    per_route = slices.groupBy("observation_date", "route").agg(
        F.map_from_entries(F.collect_list(F.struct("booking_window", F.struct(*stats)))).alias("_by_window")
    )
    rows = per_route.withColumn("booking_window", F.explode(F.array(*[F.lit(w) for w in windows])))
    rows = rows.withColumn("_s", F.col("_by_window")[F.col("booking_window")]).select(*SLICE, "_s.*")
    any_success = F.max(F.col("status") == SUCCESS).over(Window.partitionBy("observation_date", "route"))
    return _with_status(rows, K.BASE_INDEX, min_pairs).withColumn(
        "route_status", F.when(any_success, SUCCESS).otherwise(INSUFFICIENT)
    )


def first_day(observations: DataFrame) -> Column:
    """The earliest date, found while the query runs; only the date column is read for it."""
    return observations.agg(F.min("observation_date")).scalar()


def fixed_base_slices(
    observations: DataFrame, base_date: Column | None = None, include_travel_date: bool = False, allow_suspect: bool = False,
    min_pairs: int = 1,
) -> DataFrame:
    """Slice results of every later date against the quotes of one base date (the first when none is given)."""
    from .pairing import _priced

    base = first_day(observations) if base_date is None else base_date
    best = (
        _priced(observations, include_travel_date, allow_suspect)
        .groupBy(*SLICE, "fingerprint")
        .agg(F.min("fare").alias("fare"), F.count(F.lit(1)).alias("raw"))
        .withColumn("_base", base)
        .filter(F.col("observation_date") >= F.col("_base"))
    )
    # A product has one row per day, so its window is no longer than the calendar.
    product = Window.partitionBy("route", "booking_window", "fingerprint")
    is_base = F.col("observation_date") == F.col("_base")
    best = best.withColumn("base_fare", F.max(F.when(is_base, F.col("fare"))).over(product))
    relative = finite(F.try_divide("fare", "base_fare"))
    usable = F.when(relative > 0, relative)
    stats = best.groupBy(*SLICE, "_base").agg(
        F.exp(F.avg(F.ln(usable))).alias("geometric_mean"),
        F.count(usable).alias("num_matched_pairs"),
        F.sum("raw").alias("num_current_observations"),
    )
    # Base routes appear on every later day, quoted or not: gather the days of a slice and lay them out again. The days, one entry for each
    # calendar day, come from the slice table, whose shuffle both uses share.
    days = stats.agg(F.array_sort(F.collect_set("observation_date"))).scalar()
    fields = ["geometric_mean", "num_matched_pairs", "num_current_observations"]
    per_slice = stats.groupBy("route", "booking_window", "_base").agg(
        F.map_from_entries(F.collect_list(F.struct("observation_date", F.struct(*fields)))).alias("_by_day")
    ).withColumn("num_previous_observations", F.col("_by_day")[F.col("_base")]["num_current_observations"])
    rows = per_slice.withColumn("observation_date", F.explode(days)).filter(F.col("observation_date") > F.col("_base"))
    rows = rows.withColumn("_s", F.col("_by_day")[F.col("observation_date")]).filter(
        F.col("_s").isNotNull() | F.col("num_previous_observations").isNotNull()
    )
    return _with_status(rows.select(*SLICE, "num_previous_observations", "_s.*"), K.BASE_INDEX, min_pairs)


# ------------------------------------------------------------------ national


def _basket_rows(grid: DataFrame, weights: DataFrame) -> DataFrame:
    """Grid rows with ``weight`` (null outside the basket) and ``_idx``, the value of a successful slice."""
    value = F.when((F.col("status") == SUCCESS) & F.col("index_value").isNotNull(), F.col("index_value"))
    return grid.withColumn("_idx", value).join(weights.select("route", "weight"), "route", "left")


def _group_sums() -> dict[str, Column]:
    """Aggregates of a (date, window) group: covered weight, weighted sums, basket routes seen."""
    seen = F.col("_idx").isNotNull()
    weight = F.coalesce("weight", F.lit(0.0))
    positive = seen & (weight > 0)
    return {
        "_cov": F.coalesce(F.sum(F.when(seen, weight)), F.lit(0.0)),
        "_full": F.sum(F.when(seen, weight * F.col("_idx"))),
        "_part": F.sum(F.when(positive, weight * F.col("_idx"))),
        "_positive": F.sum(F.when(positive, weight)),
    }


def _seen_routes() -> Column:
    # Routes of the basket only: the set is no longer than the configured basket.
    return F.collect_set(F.when(F.col("_idx").isNotNull() & F.col("weight").isNotNull(), F.col("route")))


def _coverage_ratio() -> Column:
    # Twelve places: the order in which weights are added must not decide about a threshold.
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_cov"))), 12)


def _basket_list(weights: DataFrame) -> Column:
    """Routes of the basket in their configured order."""
    return weights.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "route"))), lambda s: s["route"])
    ).scalar()


def _window_sums(rows: DataFrame) -> DataFrame:
    group = Window.partitionBy("observation_date", "booking_window")
    seen = F.col("_idx").isNotNull()
    weight = F.coalesce("weight", F.lit(0.0))
    return rows.withColumns(
        {
            "_cov": F.coalesce(F.sum(F.when(seen, weight)).over(group), F.lit(0.0)),
            "_positive": F.sum(F.when(seen & (weight > 0), weight)).over(group),
        }
    )


def _subbasket_share() -> Column:
    return F.coalesce(F.try_divide(F.when(F.col("weight") > 0, F.col("weight")), F.col("_positive")), F.lit(0.0))


def observed_weights(grid: DataFrame, weights: DataFrame, version: str | None = None) -> DataFrame:
    """Successful slices with their basket weight and the sub-basket weight rescaled to one."""
    weights = one_version(weights, version)
    rows = _window_sums(_basket_rows(grid, weights)).filter("_idx is not null")
    return rows.select(
        *SLICE, "index_value", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("_cov").alias("covered_weight"),
        _subbasket_share().alias("subbasket_weight"),
    )


def weight_coverage(grid: DataFrame, weights: DataFrame, version: str | None = None) -> DataFrame:
    """Coverage ratio with the present and missing basket routes per (date, window)."""
    weights = one_version(weights, version)
    rows = _basket_rows(grid, weights).groupBy("observation_date", "booking_window").agg(
        _group_sums()["_cov"].alias("_cov"), _seen_routes().alias("_seen")
    )
    return rows.withColumn("_all", _basket_list(weights)).select(
        "observation_date", "booking_window", _coverage_ratio().alias("coverage_ratio"),
        F.filter("_all", lambda r: F.array_contains("_seen", r)).alias("present_routes"),
        F.filter("_all", lambda r: ~F.array_contains("_seen", r)).alias("missing_routes"),
    )


def _percent(ratio: Column) -> Column:
    return F.concat(F.format_string("%.2f", ratio * 100.0), F.lit("%"))


def _listed(routes: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(routes, lambda r: F.concat(F.lit("'"), r, F.lit("'"))), ", "), F.lit("]"))


def _complete() -> Column:
    return F.col("coverage_ratio") >= 1.0 - K.COVERAGE_TOLERANCE


def _blocked(allow_partial: bool, min_coverage: float) -> Column:
    """Why a group gets no national index: no, incomplete or low coverage; null when it gets one."""
    cov = F.col("coverage_ratio")
    chain = F.when(cov == 0.0, "none")
    if not allow_partial:
        chain = chain.when(~_complete(), "strict")
    return chain.when(cov < min_coverage, "low")


def _weight_errors(weights: DataFrame) -> Column:
    return validate_weights(weights).agg(F.flatten(F.collect_list("errors"))).scalar()


def national_index(
    grid: DataFrame, weights: DataFrame, allow_partial: bool = False, min_coverage: float = K.MIN_COVERAGE, version: str | None = None
) -> DataFrame:
    """Weighted national index per (date, window) with coverage policy, status and warnings, in one aggregation."""
    weights = one_version(weights, version)
    sums = {name: value.alias(name) for name, value in _group_sums().items()}
    rows = (
        _basket_rows(grid, weights)
        .groupBy("observation_date", "booking_window")
        .agg(*sums.values(), _seen_routes().alias("_seen"))
        .withColumns({"_errors": _weight_errors(weights), "_all": _basket_list(weights),
                      "weight_version": weights.agg(F.max("version")).scalar(), "coverage_ratio": _coverage_ratio()})
        .withColumn("missing_routes", F.filter("_all", lambda r: ~F.array_contains("_seen", r)))
        .withColumn("_blocked", _blocked(allow_partial, min_coverage))
    )
    cov, complete = F.col("coverage_ratio"), _complete()
    failed = F.size("_errors") > 0
    missing = F.concat(
        F.lit("Missing route data for weighted routes: "), _listed(F.col("missing_routes")), F.lit(". Coverage: "), _percent(cov)
    )
    strict = F.concat(
        F.lit("Incomplete route basket under strict authoritative coverage (allow_partial_coverage=False). "
              "Missing weighted routes: "), _listed(F.col("missing_routes")), F.lit(". Coverage: "), _percent(cov),
    )
    low = F.concat(F.lit("Coverage "), _percent(cov), F.lit(" is below threshold "), _percent(F.lit(float(min_coverage))))
    texts = F.array_compact(
        F.array(
            F.when(F.size("missing_routes") > 0, missing),
            F.when(F.col("_blocked") == "none", "No observed routes match the weight configuration basket")
            .when(F.col("_blocked") == "strict", strict)
            .when(F.col("_blocked") == "low", low),
        )
    )
    open_ = ~failed & F.col("_blocked").isNull()
    return rows.select(
        "observation_date", "booking_window",
        F.when(open_ & complete, F.col("_full")).when(open_, F.try_divide("_part", "_positive")).alias("national_index"),
        F.when(failed, 0.0).otherwise(cov).alias("coverage_ratio"),
        F.when(failed, "FAILED").when(F.col("_blocked").isNotNull(), INSUFFICIENT)
        .when(complete, SUCCESS).otherwise("PARTIAL_COVERAGE").alias("status"),
        "weight_version",
        F.when(failed, F.col("_errors")).otherwise(texts).alias("warnings"),
    )


# ------------------------------------------------------------- contributions


def previous_day_index(grid: DataFrame) -> DataFrame:
    """Adds the route index of the calendar day before, null after a gap."""
    w = Window.partitionBy("route", "booking_window").orderBy("observation_date")
    adjacent = F.date_diff("observation_date", F.lag("observation_date").over(w)) == 1
    return grid.withColumn("previous_index", F.when(adjacent, F.lag("index_value").over(w)))


def carried_previous_index(grid: DataFrame, weights: DataFrame, start: float = K.BASE_INDEX) -> DataFrame:
    """Adds the last known earlier route index; basket routes start at the base level."""
    weights = one_version(weights)
    before = Window.partitionBy("route", "booking_window").orderBy("observation_date").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("index_value", ignorenulls=True).over(before)
    basket = weights.select("route", F.lit(start).alias("_start"))
    return grid.withColumn("_known", known).join(basket, "route", "left").withColumn(
        "previous_index", F.coalesce("_known", "_start")
    ).drop("_known", "_start")


def stored_previous_index(grid: DataFrame, weights: DataFrame, stored: DataFrame, start: float = K.BASE_INDEX) -> DataFrame:
    """Adds the previous index from stored route indices of the previous date, laid over the base level."""
    weights = one_version(weights)
    key = ["route", "booking_window"]
    latest = stored.filter(F.col("index_value").isNotNull()).groupBy(*key).agg(
        F.max_by(F.col("index_value").cast("double"), "calculation_timestamp").alias("_stored")
    )
    basket = weights.select("route", F.lit(start).alias("_start"))
    return grid.join(latest, key, "left").join(basket, "route", "left").withColumn(
        "previous_index", F.coalesce("_stored", "_start")
    ).drop("_stored", "_start")


def contributions(
    grid: DataFrame, weights: DataFrame, allow_partial: bool = False, min_coverage: float = K.MIN_COVERAGE, version: str | None = None
) -> DataFrame:
    """Level, point and percentage-share contributions of the routes behind each national index.

    ``grid`` carries ``previous_index``.
    """
    weights = one_version(weights, version)
    rows = (
        _window_sums(_basket_rows(grid, weights))
        .withColumns({"coverage_ratio": _coverage_ratio(), "_errors": _weight_errors(weights)})
        .filter(_blocked(allow_partial, min_coverage).isNull() & (F.size("_errors") == 0) & F.col("_idx").isNotNull())
    )
    effective = F.when(_complete(), F.coalesce("weight", F.lit(0.0))).otherwise(_subbasket_share())
    total = F.sum("point_contribution").over(Window.partitionBy("observation_date", "booking_window"))
    return (
        rows.select(*SLICE, effective.alias("weight"), F.col("_idx").alias("route_index"), "previous_index")
        .withColumn("level_contribution", F.col("weight") * F.col("route_index"))
        .withColumn("point_contribution", F.col("weight") * (F.col("route_index") - F.col("previous_index")))
        .withColumn("_total", total)
        .withColumn(
            "percentage_share_of_change",
            F.when(F.abs("_total") > 1e-6, F.try_divide("point_contribution", "_total") * 100.0),
        )
        .drop("_total")
    )


def index_change(current: Column, previous: Column) -> tuple[Column, Column]:
    """Point change and percent change; the percent is 0 for a zero previous value."""
    point = current - previous
    return point, F.when(previous == 0, F.lit(0.0)).otherwise(F.try_divide(point, previous) * 100.0)


# --------------------------------------------------- provenance and seed rows


def execution_checksum(
    national: DataFrame, counts: DataFrame, observation_set_prefix: str = "OBS", basket_version: str = K.BASKET_VERSION,
    methodology_version: str = K.METHODOLOGY_VERSION,
) -> DataFrame:
    """One reproducible SHA-256 per date over versions, dates, counts and indices rounded to six places.

    ``counts`` has observation_date, previous_date, current_count, previous_count and routes_count.
    """
    shown = F.coalesce(F.format_string("%.6f", "national_index"), F.lit("null"))
    shown = F.when(F.col("national_index").isNull(), "null").otherwise(shown)
    per_date = national.groupBy("observation_date").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("booking_window", shown.alias("v")))), lambda e: F.concat_ws("=", e["booking_window"], e["v"])),
            ",",
        ).alias("_indices"),
        F.max("weight_version").alias("weight_version"),
    )
    rows = per_date.join(counts, "observation_date").withColumn(
        "observation_set_version", F.concat(F.lit(observation_set_prefix + "_"), F.col("observation_date").cast("string"))
    )
    payload = F.to_json(
        F.struct(
            F.lit(basket_version).alias("basket_version"),
            F.col("current_count").cast("string").alias("curr_obs_count"),
            F.lit(methodology_version).alias("methodology_version"),
            F.col("_indices").alias("national_indices"),
            F.col("observation_date").cast("string").alias("obs_date"),
            F.col("observation_set_version").alias("obs_version"),
            F.col("previous_date").cast("string").alias("prev_date"),
            F.col("previous_count").cast("string").alias("prev_obs_count"),
            F.col("routes_count").cast("string").alias("routes_count"),
            F.col("weight_version").alias("weight_version"),
        )
    )
    return rows.select(
        "observation_date", "previous_date", "observation_set_version", F.lit(basket_version).alias("basket_version"),
        "weight_version", F.lit(methodology_version).alias("methodology_version"),
        F.sha2(payload, 256).alias("execution_checksum"),
    )


def base_day_rows(weights: DataFrame, base_date: Column, windows: Sequence[str] = K.WINDOWS) -> DataFrame:
    """Index 100 and contribution 0 for every window and basket route of the base day."""
    return one_version(weights).select(
        base_date.alias("observation_date"),
        F.explode(F.array(*[F.lit(w) for w in windows])).alias("booking_window"),
        F.concat(F.lit("CALC_"), base_date.cast("string"), F.lit("_BASE")).alias("calculation_version"),
        "route",
        F.lit(K.BASE_INDEX).cast("decimal(12,4)").alias("index_value"),
        F.lit(SUCCESS).alias("status"),
        F.col("weight").cast("decimal(12,8)").alias("weight"),
        F.lit(0).cast("decimal(12,4)").alias("contribution"),
    )
