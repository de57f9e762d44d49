"""Rule-based signals: anomaly, cross-source agreement, shock, pressure, confidence, event rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.fares import percent_change
from ..functions.text import finite
from ..functions.scores import clamp, fixed, ratio_signal, scaled_signal, score_level, weighted_score
from .pairing import SLICE


def _level(value: Column, levels: dict[str, float], none: str) -> Column:
    steps = sorted(levels.items(), key=lambda item: -item[1])
    chain = F.when(value >= steps[0][1], steps[0][0])
    for name, threshold in steps[1:]:
        chain = chain.when(value >= threshold, name)
    return chain.otherwise(none)


# ------------------------------------------------------------------- anomaly


def detect_anomalies(series: DataFrame, current: str = "index_value", previous: str = "previous_index", levels=None) -> DataFrame:
    """Score, severity and reason of the move from the previous to the current value."""
    c, p = F.col(current), F.col(previous)
    change = percent_change(c, p)
    rows = series.withColumns(
        {
            "point_change": F.when(p != 0, c - p),
            "percentage_change": change,
            "anomaly_score": F.abs(change),
        }
    ).withColumn("severity", _level(F.col("anomaly_score"), levels or K.ANOMALY_LEVELS, "NORMAL"))
    direction = F.when(F.col("percentage_change") > 0, "increase").otherwise("decrease")
    reason = (
        F.when(c.isNull() | p.isNull(), "Insufficient data for anomaly detection.")
        .when(p == 0, "Previous index is zero; percentage change cannot be calculated.")
        .when(
            F.col("severity") != "NORMAL",
            F.concat(F.lit("Unusual "), direction, F.lit(" of "), fixed(F.col("anomaly_score"), 2), F.lit("% in the airfare index.")),
        )
    )
    return rows.withColumn("detected", F.col("severity") != "NORMAL").withColumn("reason", reason)


def explanation(current: str = "index_value", previous: str = "previous_index") -> Column:
    """Readable text of an anomaly row."""
    where = F.concat(F.col("route"), F.lit(" ("), F.col("booking_window"), F.lit(")"))
    change = F.col("percentage_change")
    return (
        F.when(~F.col("detected"), F.concat(F.lit("No significant anomaly detected for "), where, F.lit(".")))
        .when(
            change.isNull(),
            F.concat(F.lit("Anomaly detected for "), where, F.lit(", but the percentage movement could not be determined.")),
        )
        .otherwise(
            F.concat(
                where, F.lit(" airfare index "), F.when(change > 0, "increased").otherwise("decreased"), F.lit(" by "),
                fixed(F.abs(change), 2), F.lit("% from "), fixed(F.col(previous), 2), F.lit(" to "), fixed(F.col(current), 2),
                F.lit(". Severity: "), F.col("severity"), F.lit("."),
            )
        )
    )


# -------------------------------------------------------------- cross-source


FACT_KEY = ("observation_date", "origin", "destination", "booking_window", "source")


def source_facts(observations: DataFrame) -> DataFrame:
    """The quotes at the finest grain that the signals use: rows, usable fares with their sum, and latest time per date, route, window and
    source as they are written. Sums, counts and maxima of these give every coarser figure, so the quotes are read once."""
    fare = finite(F.col("comparable_fare"))
    usable = F.when(fare > 0, fare)
    return observations.groupBy(*FACT_KEY).agg(
        F.sum(usable).alias("fare_sum"), F.count(usable).alias("fares"), F.sum(F.col("comparable_fare").cast("double")).alias("raw_sum"),
        F.count("comparable_fare").alias("raw_fares"), F.count(F.lit(1)).alias("rows"), F.max("observation_timestamp").alias("latest"),
    )


def facts_means(facts: DataFrame) -> DataFrame:
    """Mean positive fare per (date, route, window, source) from the facts; incomplete keys are left out."""
    origin, destination = F.upper(F.trim("origin")), F.upper(F.trim("destination"))
    return (
        facts.select(
            "observation_date", F.when((origin != "") & (destination != "") & (origin != destination),
                                       F.concat_ws("-", origin, destination)).alias("route"),
            F.nullif(F.upper(F.trim("booking_window")), F.lit("")).alias("booking_window"),
            F.nullif(F.upper(F.trim("source")), F.lit("")).alias("source"), "fare_sum", "fares",
        )
        .filter("fares > 0 and observation_date is not null and route is not null and booking_window is not null and source is not null")
        .groupBy(*SLICE, "source")
        .agg(F.sum("fare_sum").alias("fare_sum"), F.sum("fares").alias("quotes"))
        .withColumn("average_fare", F.col("fare_sum") / F.col("quotes"))
    )


def facts_slices(facts: DataFrame) -> DataFrame:
    """Per slice the mean fare of all its quotes as ``baseline``, its rows and its distinct sources, from the facts."""
    source = F.trim("source")
    return facts.withColumn("route", F.concat_ws("-", "origin", "destination")).groupBy(*SLICE).agg(
        (F.sum("raw_sum") / F.sum("raw_fares")).alias("baseline"), F.sum("rows").alias("observation_count"),
        F.count_distinct(F.when(source != "", source)).alias("source_count"),
    )


def facts_days(facts: DataFrame) -> DataFrame:
    """Per date the rows and the latest time, from the facts."""
    return facts.groupBy("observation_date").agg(F.sum("rows").alias("observation_count"), F.max("latest").alias("latest"))


def source_means(observations: DataFrame) -> DataFrame:
    """Mean positive fare per (date, route, window, source); incomplete rows are left out. In one aggregation, where no facts are at hand."""
    fare = finite(F.col("comparable_fare"))
    usable = F.when(fare > 0, fare)
    return facts_means(observations.select(*FACT_KEY, usable.alias("fare_sum"), F.when(usable.isNotNull(), 1).otherwise(0).alias("fares")))


def source_movements(means: DataFrame, previous: DataFrame | None = None, tolerance: float = 0.5) -> DataFrame:
    """Change of each source against the day before (or against a given earlier batch).

    With ``previous`` the batches are matched without their dates; the latest current date is reported.
    """
    key = ["route", "booking_window", "source"]
    if previous is None:
        # One row per day and source: yesterday's mean stands right before today's.
        w = Window.partitionBy(*key).orderBy("observation_date")
        adjacent = F.date_diff("observation_date", F.lag("observation_date").over(w)) == 1
        joined = means.withColumn("previous_fare", F.when(adjacent, F.lag("average_fare").over(w))).withColumnRenamed("average_fare", "current_fare")
    else:
        def batch(df, name):
            return df.groupBy(*key).agg((F.sum("fare_sum") / F.sum("quotes")).alias(name), F.max("observation_date").alias("observation_date"))

        joined = batch(means, "current_fare").join(batch(previous, "previous_fare").drop("observation_date"), key)
    change = percent_change(F.col("current_fare"), F.col("previous_fare"))
    return (
        joined.withColumn("percentage_change", change)
        .filter("percentage_change is not null")
        .withColumn(
            "direction",
            F.when(F.abs("percentage_change") <= tolerance, "STABLE").when(F.col("percentage_change") > 0, "UPWARD").otherwise("DOWNWARD"),
        )
        .select(*SLICE, "source", "previous_fare", "current_fare", "percentage_change", "direction")
    )


def confirm_sources(movements: DataFrame, minimum_sources: int = 2, minimum_ratio: float = 0.5) -> DataFrame:
    """Agreement of the sources per slice. A tie goes to UPWARD, then DOWNWARD, then STABLE."""
    def named(direction):
        return F.sort_array(F.collect_list(F.when(F.col("direction") == direction, F.col("source"))))

    # One row per source: the arrays are as long as the list of accepted sources.
    g = movements.groupBy(*SLICE).agg(
        F.sort_array(F.collect_list("source")).alias("sources"), named("UPWARD").alias("up"), named("DOWNWARD").alias("down"),
        named("STABLE").alias("flat"),
    )
    n, up, down, flat = F.size("sources"), F.size("up"), F.size("down"), F.size("flat")
    leads = F.when((up >= down) & (up >= flat), "UPWARD").when(down >= flat, "DOWNWARD").otherwise("STABLE")
    enough = n >= minimum_sources
    g = g.withColumn("direction", F.when(enough, leads)).withColumn("source_count", n)
    none = F.array().cast("array<string>")
    g = g.withColumn(
        "agreeing_sources",
        F.when(F.col("direction") == "UPWARD", F.col("up")).when(F.col("direction") == "DOWNWARD", F.col("down"))
        .when(F.col("direction") == "STABLE", F.col("flat")).otherwise(none),
    ).withColumn("agreement_ratio", F.when(enough, F.size("agreeing_sources") / n))
    agree = F.size("agreeing_sources")
    confirmed = enough & (agree >= minimum_sources) & (F.col("agreement_ratio") >= minimum_ratio) & (F.col("direction") != "STABLE")
    g = g.withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
    supports = F.concat(agree.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" sources support a "), F.lower("direction"), F.lit(" movement."))
    return g.select(
        *SLICE, "sources", "source_count", "agreeing_sources", "agreement_ratio", "direction", "confirmed",
        F.when(~enough, "INSUFFICIENT").when(~F.col("confirmed"), "WEAK").when(F.col("agreement_ratio") >= 0.75, "STRONG")
        .otherwise("MODERATE").alias("strength"),
        F.when(~enough, "Insufficient independent sources for cross-source confirmation.")
        .when(~F.col("confirmed"), "Sources do not provide sufficient directional agreement for confirmation.")
        .otherwise(supports).alias("reason"),
        F.when(enough, "SUCCESS").otherwise("INSUFFICIENT_DATA").alias("status"),
    )


# --------------------------------------------------------------------- shock


def with_previous_change(grid: DataFrame) -> DataFrame:
    """Adds the percentage movement of the calendar day before, null after a gap."""
    w = Window.partitionBy("route", "booking_window").orderBy("observation_date")
    adjacent = F.date_diff("observation_date", F.lag("observation_date").over(w)) == 1
    rows = grid.withColumn("_change", percent_change(F.col("index_value"), F.col("previous_index")))
    return rows.withColumn("previous_change", F.when(adjacent, F.lag("_change").over(w))).drop("_change")


def shock_movements(
    grid: DataFrame, previous_movement: DataFrame | None = None, baseline: DataFrame | None = None, quality: DataFrame | None = None,
) -> DataFrame:
    """Route movements with acceleration, deviation from a baseline and quality status.

    The optional frames are keyed by slice: previous_movement(previous_change), baseline(baseline), quality(route_quality).
    A grid that has ``previous_change`` already needs no such frame.
    """
    own = [c for c in ("previous_change",) if c in grid.columns]
    rows = grid.filter("index_value > 0 and previous_index > 0").select(*SLICE, "index_value", "previous_index", *own)
    for side in (previous_movement, baseline, quality):
        if side is not None:
            rows = rows.join(side, SLICE, "left")
    for name, kind in (("previous_change", "double"), ("baseline", "double"), ("route_quality", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    change = percent_change(F.col("index_value"), F.col("previous_index"))
    base = F.when(F.col("baseline") > 0, F.col("baseline"))
    return rows.withColumn("percentage_change", change).withColumns(
        {
            "absolute_change": F.abs("percentage_change"),
            "acceleration": F.col("percentage_change") - F.col("previous_change"),
            "historical_deviation": percent_change(F.col("index_value"), base),
            "quality_status": F.upper(F.coalesce("route_quality", F.lit("VALID"))),
        }
    ).drop("previous_change", "baseline", "route_quality")


def detect_shocks(
    movements: DataFrame, groups: DataFrame, confirmations: DataFrame | None = None, *, levels=None, minimum_routes: int = 2,
    minimum_ratio: float = 0.5, acceleration_threshold: float = 2.0, deviation_threshold: float = 5.0,
    minimum_coverage: float = 0.5, maximum_freshness: float | None = 48.0,
) -> DataFrame:
    """Stage, severity and evidence per (date, window).

    ``groups`` lists the (date, window) pairs to judge, with coverage_ratio and freshness_hours (null when unknown).
    """
    levels = levels or K.SHOCK_LEVELS
    key = ["observation_date", "booking_window"]
    rows = movements
    if confirmations is None:
        rows = rows.withColumn("confirmed", F.lit(False))
    else:
        rows = rows.join(confirmations.select(*SLICE, "confirmed"), SLICE, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    affected = F.col("absolute_change") >= levels["LOW"]

    def routes(condition):
        return F.sort_array(F.collect_list(F.when(F.coalesce(condition, F.lit(False)), F.col("route"))))

    # One row per route: the arrays are as long as the list of routes.
    g = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("comparable_route_count"),
        F.avg("percentage_change").alias("average_movement"),
        F.max("absolute_change").alias("maximum_movement"),
        F.min_by("route", F.struct(-F.col("absolute_change"), F.col("route"))).alias("maximum_movement_route"),
        routes(affected).alias("affected_routes"),
        routes(F.abs("acceleration") >= acceleration_threshold).alias("acceleration_routes"),
        routes(affected & F.col("confirmed")).alias("cross_source_confirmed_routes"),
        routes(F.abs("historical_deviation") >= deviation_threshold).alias("historical_support_routes"),
        F.count_if(~F.col("quality_status").isin("EXCLUDED", "OUTLIER")).alias("_usable"),
    )
    g = groups.select(*key, "coverage_ratio", "freshness_hours").join(g, key, "left")
    none = F.array().cast("array<string>")
    g = g.withColumns({c: F.coalesce(c, none) for c in (
        "affected_routes", "acceleration_routes", "cross_source_confirmed_routes", "historical_support_routes")})
    n = F.coalesce("comparable_route_count", F.lit(0))
    hit = F.size("affected_routes")
    cov, fresh = F.col("coverage_ratio"), F.col("freshness_hours")
    judged = n > 0
    fresh_ok = F.lit(True) if maximum_freshness is None else fresh.isNull() | (fresh <= maximum_freshness)
    g = g.withColumns(
        {
            "comparable_route_count": n,
            "affected_route_count": hit,
            "affected_route_ratio": F.coalesce(F.try_divide(hit, n), F.lit(0.0)),
            "quality_ratio": F.coalesce(F.try_divide(F.col("_usable"), n), F.lit(0.0)),
            "acceleration_detected": F.size("acceleration_routes") > 0,
            "cross_source_confirmed": F.size("cross_source_confirmed_routes") > 0,
            "coverage_ok": judged & (cov.isNull() | (cov >= minimum_coverage)),
            "freshness_ok": judged & fresh_ok,
            "quality_ok": judged & (F.col("_usable") > 0),
            # The empty result carries neither coverage nor freshness.
            "coverage_ratio": F.when(judged, cov),
            "freshness_hours": F.when(judged, fresh),
        }
    ).drop("_usable")
    many = (F.col("affected_route_count") >= minimum_routes) & (F.col("affected_route_ratio") >= minimum_ratio)
    potential = (
        (F.col("maximum_movement") >= levels["LOW"]) & many & F.col("cross_source_confirmed")
        & F.col("coverage_ratio").isNotNull() & F.col("freshness_hours").isNotNull()
        & F.col("coverage_ok") & F.col("freshness_ok") & F.col("quality_ok")
    )
    g = g.withColumns(
        {
            "detected": F.coalesce(potential, F.lit(False)),
            "severity": F.when(F.col("comparable_route_count") > 0, _level(F.col("maximum_movement"), levels, "NONE")).otherwise("NONE"),
        }
    ).withColumn(
        "stage",
        F.when(F.col("detected"), "POTENTIAL_AIRFARE_SHOCK").when(F.col("cross_source_confirmed"), "CROSS_SOURCE_CONFIRMATION")
        .when(many, "MULTIPLE_ROUTES").when(F.col("acceleration_detected"), "ACCELERATION").otherwise("NORMAL"),
    )
    avg = F.col("average_movement")
    g = g.withColumn("direction", F.when(avg > 0, "upward").when(avg < 0, "downward").when(avg == 0, "stable"))
    return g.withColumn("reason", _shock_reason())


def _shock_reason() -> Column:
    def counted(name):
        return F.size(name).cast("string")

    parts = [
        F.concat(F.lit("Overall movement was "), F.col("direction"), F.lit(".")),
        F.concat(F.lit("Maximum route movement was "), fixed(F.col("maximum_movement"), 2), F.lit("%.")),
        F.concat(F.col("affected_route_count").cast("string"), F.lit(" of "), F.col("comparable_route_count").cast("string"),
                 F.lit(" comparable routes met the movement threshold.")),
        F.when(F.col("acceleration_detected"),
               F.concat(F.lit("Acceleration was observed on "), counted("acceleration_routes"), F.lit(" route(s)."))),
        F.when(F.col("cross_source_confirmed"),
               F.concat(F.lit("Cross-source confirmation was available for "), counted("cross_source_confirmed_routes"),
                        F.lit(" affected route(s)."))),
        F.when(F.size("historical_support_routes") > 0,
               F.concat(counted("historical_support_routes"),
                        F.lit(" route(s) also deviated materially from the supplied historical baseline."))),
        F.when(F.col("coverage_ratio").isNotNull(),
               F.concat(F.lit("Coverage ratio was "), fixed(F.col("coverage_ratio"), 2), F.lit("."))),
        F.when(F.col("freshness_hours").isNotNull(),
               F.concat(F.lit("Observation freshness was "), fixed(F.col("freshness_hours"), 2), F.lit(" hour(s)."))),
        F.concat(F.lit("Usable data-quality ratio was "), fixed(F.col("quality_ratio"), 2), F.lit(".")),
        F.concat(F.lit("Evidence stage: "), F.col("stage"), F.lit(".")),
        F.when(~F.col("detected"), F.lit("The evidence is treated as a supporting intelligence signal rather than an official "
                                         "airfare-shock classification.")),
    ]
    return F.when(F.col("comparable_route_count") > 0, F.concat_ws(" ", *parts)).otherwise(
        "Insufficient comparable route-level data for shock detection."
    )


# -------------------------------------------------------------------- scores


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def pressure_score(df: DataFrame, weights=None) -> DataFrame:
    """Adds pressure_score, pressure_level and pressure_reason.

    Reads percentage_change and, where present, acceleration, anomaly_score, agreement_ratio, route_coverage,
    source_coverage, lead_time_pressure and demand_availability_signal.
    """
    change, acceleration, anomaly = (_given(df, n) for n in ("percentage_change", "acceleration", "anomaly_score"))
    ratios = {
        "agreement": ("agreement_ratio", "Cross-source agreement was", "%."),
        "route_coverage": ("route_coverage", "Route coverage was", "%."),
        "source_coverage": ("source_coverage", "Source coverage was", "%."),
        "lead_time": ("lead_time_pressure", "Lead-time pressure signal was", "/100."),
        "demand_availability": ("demand_availability_signal", "Demand/availability signal was", "/100."),
    }
    signals = {
        "movement": scaled_signal(change, 20.0), "acceleration": scaled_signal(acceleration, 10.0),
        "anomaly": clamp(F.abs(anomaly)), **{k: ratio_signal(_given(df, c)) for k, (c, _, _) in ratios.items()},
    }
    score = F.when(change.isNotNull(), weighted_score(signals, weights or K.PRESSURE_WEIGHTS))
    moved = F.when(change > 0, "increased").when(change < 0, "decreased").otherwise("remained stable")
    sped = F.when(acceleration > 0, "accelerated upward").when(acceleration < 0, "accelerated downward").otherwise("showed no acceleration")
    parts = [
        F.concat(F.lit("Fare pressure score is "), F.col("pressure_score").cast("string"), F.lit("/100 because the fare "), moved,
                 F.lit(" by "), fixed(F.abs(change), 2), F.lit("%.")),
        F.concat(F.lit("Movement "), sped, F.lit(" by "), fixed(F.abs(acceleration), 2), F.lit(" percentage points.")),
        F.concat(F.lit("Anomaly signal was "), fixed(signals["anomaly"], 1), F.lit("/100.")),
    ]
    parts += [F.concat(F.lit(said + " "), fixed(signals[k], 1), F.lit(end)) for k, (_, said, end) in ratios.items()]
    reason = (
        F.when(change.isNull(), "Insufficient fare movement data.")
        .when(F.col("pressure_score").isNull(), "No valid pressure signals are available.")
        .otherwise(F.concat_ws(" ", *parts))
    )
    return df.withColumn("pressure_score", score).withColumns(
        {"pressure_level": score_level(F.col("pressure_score")), "pressure_reason": reason}
    )


def confidence_score(df: DataFrame, weights=None, maximum_freshness: float = 48.0) -> DataFrame:
    """Adds confidence_score, confidence_level and confidence_reason.

    Reads coverage_ratio and, where present, source_coverage, observation_count, expected_observation_count,
    agreement_ratio, data_quality, freshness_hours and anomaly_available.
    """
    if maximum_freshness <= 0:
        raise ValueError("maximum_freshness must be positive")
    coverage, source, agreement, quality, fresh = (
        _given(df, n) for n in ("coverage_ratio", "source_coverage", "agreement_ratio", "data_quality", "freshness_hours")
    )
    found, wanted = _given(df, "observation_count"), _given(df, "expected_observation_count")
    volume = F.when((wanted > 0) & (found >= 0), F.least(F.lit(1.0), F.try_divide(found, wanted)))
    age = F.greatest(fresh, F.lit(0.0))
    freshness = F.when(fresh.isNotNull(), clamp((F.lit(1.0) - age / maximum_freshness) * 100.0))
    available = F.coalesce(F.col("anomaly_available"), F.lit(False)) if "anomaly_available" in df.columns else F.lit(False)
    signals = {
        "coverage": ratio_signal(coverage), "source_coverage": ratio_signal(source), "observation_volume": ratio_signal(volume),
        "agreement": ratio_signal(agreement), "data_quality": ratio_signal(quality), "freshness": freshness,
        "anomaly": F.when(available, 100.0).otherwise(0.0),
    }
    score = F.when(coverage.isNotNull(), weighted_score(signals, weights or K.CONFIDENCE_WEIGHTS))
    parts = [
        F.concat(F.lit("Confidence support score is "), F.col("confidence_score").cast("string"),
                 F.lit("/100 based on available coverage, source agreement, observation quality, freshness, and anomaly evidence.")),
        F.concat(F.lit("Route coverage was "), fixed(signals["coverage"], 1), F.lit("%.")),
        F.concat(F.lit("Source coverage was "), fixed(signals["source_coverage"], 1), F.lit("%.")),
        F.concat(F.lit("Observation volume was "), fixed(signals["observation_volume"], 1), F.lit("% of expected.")),
        F.concat(F.lit("Cross-source agreement was "), fixed(signals["agreement"], 1), F.lit("%.")),
        F.concat(F.lit("Data quality signal was "), fixed(signals["data_quality"], 1), F.lit("/100.")),
        F.when(fresh.isNotNull(), F.concat(F.lit("Freshness was "), fixed(age, 2), F.lit(" hours."))),
        F.concat(F.lit("Anomaly evidence was "), F.when(available, "available.").otherwise("not available.")),
    ]
    reason = (
        F.when(coverage.isNull(), "Insufficient coverage information.")
        .when(F.col("confidence_score").isNull(), "No valid confidence-support signals are available.")
        .otherwise(F.concat_ws(" ", *parts))
    )
    return df.withColumn("confidence_score", score).withColumns(
        {"confidence_level": score_level(F.col("confidence_score")), "confidence_reason": reason}
    )


# -------------------------------------------------------------------- events


def event_rows(anomalies: DataFrame, source: str = "MOCK") -> DataFrame:
    """Stored events: detected moves, with their explanation, or a score of 3 and more. ``source`` is the source of the run."""
    score = F.col("anomaly_score")
    shock = F.col("detected") & (score >= 4.0)
    text = F.coalesce(F.when(F.col("detected"), explanation()), F.col("reason"), F.concat(F.lit("Price movement on "), F.col("route"), F.lit(" for "), F.col("booking_window")))
    return anomalies.filter(F.col("detected") | (score >= 3.0)).select(
        "observation_date", "booking_window", "route",
        F.when(shock, "AIRFARE_SHOCK").otherwise("ANOMALY").alias("event_type"),
        F.bround(score, 4).alias("anomaly_score"),
        F.bround(clamp(F.coalesce(score, F.lit(0.0)) * 10.0 + 35.0), 4).alias("pressure_score"),
        F.when(shock, "ALERT").otherwise("NORMAL").alias("shock_status"),
        text.alias("explanation"),
        F.array(F.lit(source)).alias("affected_sources"),
        F.array("route").alias("affected_routes"),
        F.lit(K.MODEL_VERSION).alias("model_version"),
    )
