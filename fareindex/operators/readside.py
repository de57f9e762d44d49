"""Queries over stored results."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from .index import one_version
from ..functions.fares import percent_change
from ..functions.text import valid_route


def read_filter(
    df: DataFrame, start: str | None = None, end: str | None = None, window: str | None = None, source: str | None = None,
    route: str | None = None, shocks_only: bool = False, date: str = "observation_date",
) -> DataFrame:
    """Optional date range, window, source, route and shock filters; all of them reach the scan."""
    if start and end and start > end:
        raise ValueError("start date must not be after end date")
    if start:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    if window:
        df = df.filter(F.col("booking_window") == window)
    if source:
        df = df.filter(F.col("source") == source)
    if route:
        df = df.filter(F.col("route") == route.upper())
    if shocks_only:
        df = df.filter(F.col("event_type").isin("SHOCK", "AIRFARE_SHOCK"))
    return df


RUN_KEY = ("observation_date", "booking_window", "calculation_version")


def finished(rows: DataFrame, results: DataFrame | None) -> DataFrame:
    """Rows of finished calculations. The results are written last and so are the list of what is complete: rows of a run that is still
    being written, or that failed half-way, are left out. Without results the rows as they are."""
    return rows if results is None else rows.join(results.select(*RUN_KEY), list(RUN_KEY), "left_semi").select(*rows.columns)


def finished_events(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events of finished calculations; an event carries the time of its calculation."""
    done = results.select("observation_date", "booking_window", F.col("calculation_timestamp").alias("event_timestamp"))
    return events.join(done, ["observation_date", "booking_window", "event_timestamp"], "left_semi").select(*events.columns)


def latest_runs(results: DataFrame, key: Sequence[str] = ("observation_date", "booking_window")) -> DataFrame:
    """The latest calculation of each key among reruns; reruns collapse before the shuffle."""
    rest = [c for c in results.columns if c not in key]
    order = F.struct("calculation_timestamp", "calculation_version")
    return results.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(*results.columns)


def with_previous(results: DataFrame, key: Sequence[str] = ("booking_window",), value: str = "index_value") -> DataFrame:
    """Value of the latest earlier date with the same key, and the change in percent; one row per key and date."""
    w = Window.partitionBy(*key).orderBy("observation_date")
    before = F.lag(value).over(w)
    return results.withColumn("previous_index", before).withColumn(
        "change_percent", percent_change(F.col(value).cast("double"), F.col("previous_index").cast("double"))
    )


def current_index(results: DataFrame, window: str | None = None) -> DataFrame:
    """Latest result, the headline window preferred when none is named, with the previous value and the change."""
    rows = with_previous(latest_runs(results if window is None else results.filter(F.col("booking_window") == window)))
    preferred = F.when(F.col("booking_window") == K.HEADLINE_WINDOW, 0).otherwise(1)
    return rows.orderBy(F.desc("observation_date"), preferred, F.desc("calculation_timestamp"), "booking_window").limit(1)


def index_history(results: DataFrame, start: str | None = None, end: str | None = None, window: str | None = None) -> DataFrame:
    return latest_runs(read_filter(results, start, end, window)).orderBy("observation_date", "booking_window")


def latest_route_index(route_indices: DataFrame, window: str | None = None, results: DataFrame | None = None) -> DataFrame:
    """Latest index of every route (per window when none is named the newest of any) with the change in percent, of finished runs where
    the results are given."""
    route_indices = finished(route_indices, results)
    rows = route_indices if window is None else route_indices.filter(F.col("booking_window") == window)
    rows = with_previous(latest_runs(rows, ("route", "booking_window", "observation_date")), ("route", "booking_window"))
    rest = [c for c in rows.columns if c != "route"]
    order = F.struct("observation_date", "calculation_timestamp", "booking_window")
    return rows.groupBy("route").agg(F.max_by(F.struct(*rest), order).alias("r")).select("route", "r.*")


def _latest_success(results: DataFrame, window: str | None) -> DataFrame:
    preferred = F.when(F.col("booking_window") == (window or K.HEADLINE_WINDOW), 0).otherwise(1)
    return (
        results.filter("status = 'SUCCESS'")
        .orderBy(preferred, F.desc("observation_date"), F.desc("calculation_timestamp"), "booking_window")
        .limit(1)
    )


def contribution_ranking(results: DataFrame, route_indices: DataFrame, window: str | None = None) -> DataFrame:
    """Routes of the latest SUCCESS result by level contribution, with their share of the total change."""
    chosen = _latest_success(results, window).select("observation_date", "booking_window", "calculation_version")
    rows = route_indices.join(F.broadcast(chosen), ["observation_date", "booking_window", "calculation_version"])  # one row
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.1))
    level = F.coalesce(F.col("index_value").cast("double"), F.lit(100.0))
    stored = F.col("contribution").cast("double")
    rows = rows.select(
        "route", weight.alias("weight"), level.alias("route_index"), F.bround(weight * level, 2).alias("level_contribution"),
        F.coalesce(stored, F.bround(weight * (level - 100.0), 2)).alias("point_contribution"),
        F.coalesce(stored, F.lit(0.0)).alias("_stored"),
    )
    total = F.sum("_stored").over(Window.partitionBy(F.lit(1)))  # the routes of one result
    share = F.when(total != 0, F.bround(F.try_divide("point_contribution", total) * 100, 1)).otherwise(0.0)
    return rows.withColumn("percentage_share_of_change", share).drop("_stored").orderBy(F.desc("level_contribution"), "route")


def list_routes(routes: DataFrame) -> DataFrame:
    return routes.select(F.col("code").alias("route"), "origin", "destination", "active").orderBy("route")


def route_window_matrix(routes: DataFrame, results: DataFrame, route_indices: DataFrame) -> DataFrame:
    """Latest SUCCESS value per route and window as a table with one column per window, 100 where there is none."""
    good = results.filter("status = 'SUCCESS'").select("observation_date", "booking_window", "calculation_version")
    rows = route_indices.join(good, ["observation_date", "booking_window", "calculation_version"], "left_semi")
    cells = [
        F.bround(
            F.coalesce(
                F.max_by(
                    F.when(F.col("booking_window") == w, F.struct(F.col("index_value").cast("double").alias("v"))),
                    F.when(F.col("booking_window") == w, F.struct("observation_date", "calculation_timestamp")),
                )["v"],
                F.lit(100.0),
            ),
            1,
        ).alias(w)
        for w in K.WINDOWS
    ]
    latest = rows.groupBy("route").agg(*cells)
    listed = routes.select(F.col("code").alias("route"))
    return listed.join(latest, "route", "left").na.fill(100.0, list(K.WINDOWS)).orderBy("route")


def window_comparison(results: DataFrame) -> DataFrame:
    """Histories of all windows side by side, one row per date."""
    return (
        latest_runs(results).groupBy("observation_date").pivot("booking_window", list(K.WINDOWS))
        .agg(F.first(F.col("index_value").cast("double"))).orderBy("observation_date")
    )


def last_points(results: DataFrame, points: int, window: str = K.HEADLINE_WINDOW) -> DataFrame:
    """The last points of one series, oldest first."""
    rows = latest_runs(results.filter(F.col("booking_window") == window))
    return rows.orderBy(F.desc("observation_date")).limit(points).orderBy("observation_date")


def point_range(points: DataFrame) -> DataFrame:
    """Axis range around the points."""
    value = F.coalesce(F.col("index_value").cast("double"), F.lit(100.0))
    return points.agg(F.floor(F.min(value) - 2).alias("low"), F.ceil(F.max(value) + 2).alias("high"))


def pressure_ranking(events: DataFrame, top: int = 5) -> DataFrame:
    """Routes by their highest pressure; the score falls back to the anomaly score."""
    score = F.coalesce(F.col("pressure_score").cast("double"), F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)) * 10 + 35)
    order = F.struct(F.col("_s"), F.col("observation_date"), F.col("booking_window"))
    best = events.filter("route is not null").withColumn("_s", score).groupBy("route").agg(
        F.floor(F.max("_s") + 0.5).cast("int").alias("score"),
        F.max_by(F.coalesce("explanation", F.lit("Market movement alert")), order).alias("trend"),
    )
    rows = best.orderBy(F.desc("score"), "route").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "route"))  # at most ``top`` rows
    return rows.select(
        rank.alias("rank"), "route", "score",
        F.when(F.col("score") >= 75, "HIGH_PRESSURE").when(F.col("score") >= 50, "MODERATE_PRESSURE").otherwise("NORMAL").alias("status"),
        "trend",
    )


SORT_FIELDS = {"index": "index_value", "change": "change_percent", "weight": "weight", "pressure": "pressure_score"}


def sort_routes(rows: DataFrame, field: str, descending: bool = True) -> DataFrame:
    """Route table by one field, absent values counting as 0."""
    key = F.coalesce(F.col(SORT_FIELDS[field]).cast("double"), F.lit(0.0))
    return rows.orderBy(key.desc() if descending else key.asc(), "route")


def list_events(events: DataFrame, shocks_only: bool = False) -> DataFrame:
    return read_filter(events, shocks_only=shocks_only).orderBy(F.desc("event_timestamp"), "route", "booking_window")


def list_quality(metrics: DataFrame, route: str | None = None, source: str | None = None) -> DataFrame:
    return read_filter(metrics, route=route, source=source).orderBy(F.desc("generated_at"), "source")


def run_status(results: DataFrame) -> DataFrame:
    """The latest stored calculation as a status row."""
    return results.orderBy(F.desc("observation_date"), F.desc("calculation_timestamp"), "booking_window").limit(1).select(
        F.lit("ACTIVE").alias("status"), F.col("observation_date").alias("latest_observation_date"),
        F.col("booking_window").alias("latest_booking_window"), F.col("index_value").cast("double").alias("latest_index_value"),
        "calculation_version", "calculation_timestamp", "execution_checksum",
    )


def route_star(route_indices: DataFrame, routes: DataFrame, results: DataFrame) -> DataFrame:
    """Route indices with their route and the national value of the same calculation."""
    national = results.select("observation_date", "booking_window", "calculation_version", F.col("index_value").alias("national_index"),
                              F.col("status").alias("national_status"))
    return route_indices.join(national, ["observation_date", "booking_window", "calculation_version"]).join(
        routes.select(F.col("code").alias("route"), "origin", "destination"), "route"
    )


def simulate(scenarios: DataFrame, results: DataFrame, weights: DataFrame, version: str | None = None) -> DataFrame:
    """What-if table: effect of a route shock on the latest SUCCESS index; the index itself is not changed.

    ``scenarios`` has route, shock_percent and optionally projected_index, which then overrides the estimate.
    """
    weights = one_version(weights, version)
    current = (
        results.filter("status = 'SUCCESS'")
        .agg(F.max_by(F.col("index_value").cast("double"), F.struct("observation_date", "calculation_timestamp", "booking_window")))
        .scalar()
    )
    if "projected_index" not in scenarios.columns:
        scenarios = scenarios.withColumn("projected_index", F.lit(None).cast("double"))
    rows = scenarios.withColumn("route", valid_route(F.col("route"))).filter(F.col("route").isNotNull())
    rows = rows.withColumn("current_index", current).filter(F.col("current_index").isNotNull())
    rows = rows.withColumnRenamed("projected_index", "_given").join(weights.select("route", "weight"), "route", "left")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.10))
    impact = F.bround(F.col("current_index") * weight * F.col("shock_percent") / 100.0, 4)
    return rows.select(
        "route", "shock_percent", "current_index",
        F.coalesce("_given", F.bround(F.col("current_index") + impact, 4)).alias("projected_index"),
        F.coalesce(F.col("_given") - F.col("current_index"), impact).alias("impact_points"),
        F.lit("SIMULATED").alias("status"),
    )
