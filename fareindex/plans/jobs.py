"""Jobs over stored tables: one incremental day, a history that resumes, a fixed-base run.

Every job cleans a batch in one pass into a work table and takes everything else from it, calculates the grid once into another, writes
routes and events before the results, and returns a summary whose figures come from the writes themselves.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.local import small_table
from ..operators import cleaning, index as ix, quality, readside, signals
from ..schemas import INDEX_RESULTS, QUALITY_METRICS, ROUTE_INDICES, STORED_FARES, WEIGHTS
from ..session import staged
from ..sources import quotes, stores
from .calculation import IndexRun, daily_index, fixed_base_index, from_grid, historical_index

OBSERVATIONS, RESULTS, ROUTE_RESULTS, EVENTS = "fare_observations", "index_results", "route_indices", "intelligence_events"
QUALITY, ROUTES, REFERENCE = "quality_metrics", "routes", "cpi_reference"

EVENT_KEY = ("observation_date", "booking_window", "route", "event_type", "event_timestamp")
QUALITY_KEY = ("metric_date", "source", "generated_at")
EVENT_SCHEMA = (
    "observation_date date, booking_window string, route string, event_type string, anomaly_score double, pressure_score double, "
    "shock_status string, explanation string, affected_sources array<string>, affected_routes array<string>, model_version string, "
    "event_timestamp timestamp"
)
#: The fields of a run summary, in order.
SUMMARY = (
    "status", "mode", "historical_days", "cold_start", "observation_date", "previous_observation_date", "calculation_version", "national_indices",
    "total_processed", "observations_stored", "valid_observations", "outlier_observations", "duplicate_observations", "rejected_observations",
    "routes_processed", "index_results_stored", "route_indices_stored", "intelligence_events_stored", "quality_metrics_stored",
    "reference_records", "execution_checksum",
)


@dataclass
class Report:
    """The run of a job and the figures of its writes."""

    mode: str
    run: IndexRun | None = None
    cold_start: bool = False
    historical_days: int = 0
    observation_date: dt.date | None = None
    previous_date: dt.date | None = None
    calculation_version: str | None = None
    national_indices: dict[str, float] = field(default_factory=dict)
    execution_checksum: str = "0" * 64
    figures: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def add(self, **figures: int | None) -> None:
        for name, n in figures.items():
            self.figures[name] = self.figures.get(name, 0) + (n or 0)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The summary as one row."""
        known = {
            "status": F.lit("SUCCESS"), "mode": F.lit(self.mode), "historical_days": F.lit(self.historical_days), "cold_start": F.lit(self.cold_start),
            "observation_date": F.lit(self.observation_date).cast("date"), "previous_observation_date": F.lit(self.previous_date).cast("date"),
            "calculation_version": F.lit(self.calculation_version), "execution_checksum": F.lit(self.execution_checksum),
            "national_indices": F.create_map(*[F.lit(x) for e in sorted(self.national_indices.items()) for x in e]).cast("map<string,double>"),
        }
        count = lambda name: F.lit(self.figures.get(name, 0)).cast("long")
        return spark.range(1).select(*[known.get(n, count(n)).alias(n) for n in SUMMARY])


def stored_schema(df: DataFrame) -> str:
    """The schema of a frame as text, for a table that has none written yet."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def resolve_weights(spark: SparkSession, weights: DataFrame | None, version: str | None) -> DataFrame:
    """The basket of a run as literal rows: the configured table is read once, whatever asks for it later."""
    chosen = ix.one_version(ix.demo_weights(spark) if weights is None else weights, version)
    names = [c.split(" ")[0] for c in WEIGHTS.split(", ")]
    typed = chosen.select(*[(F.col(c) if c in chosen.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split(" ") for x in WEIGHTS.split(", "))])
    return small_table(spark, [tuple(r[c] for c in names) for r in typed.collect()], WEIGHTS)


def ingest(
    spark: SparkSession, raw: DataFrame, root: str, report: Report, generated_at: Column | None, expected_routes: DataFrame,
    in_place: bool = False,
) -> DataFrame:
    """Clean one batch, store its observations, routes and quality rows, and note the figures; returns the assessed rows.

    ``in_place`` rewrites the dates of the batch instead of adding what is new.
    """
    status = F.col("quality_status")
    rows, seen = staged(cleaning.assessed(raw), "assessed", valid=F.count_if(status == "VALID"), outlier=F.count_if(status == "OUTLIER"),
                        copies=F.count_if(status == "EXCLUDED"), lost=F.count_if(status == cleaning.REJECTED))
    kept = rows.filter(status != cleaning.REJECTED).drop("_raw")
    if in_place:
        added = stores.replace_days(stores.storable_observations(kept.filter("observation_timestamp IS NOT NULL")), f"{root}/{OBSERVATIONS}")
    else:
        added = stores.persist_observations(kept, f"{root}/{OBSERVATIONS}")
    metrics = quality.daily_assessed(rows, expected_routes, generated_at)
    metrics = metrics.select(*[c for c in metrics.columns if not c.startswith("_")])
    stores.upsert_routes(kept, f"{root}/{ROUTES}")
    report.add(
        total_processed=seen["rows"], valid_observations=seen["valid"], outlier_observations=seen["outlier"], duplicate_observations=seen["copies"],
        rejected_observations=seen["lost"], observations_stored=added,
        quality_metrics_stored=stores.append_new(metrics, f"{root}/{QUALITY}", QUALITY_METRICS, QUALITY_KEY, None),
    )
    return rows


def store_run(
    spark: SparkSession, run: IndexRun, weights: DataFrame, root: str, report: Report, version: str, at: Column, source: str, in_place: bool = False,
    allow_partial: bool = True, previous_date: Column | None = None,
) -> IndexRun:
    """Store events, route rows and, last, the results of a run, each by its key, or in place of their dates with ``in_place``.

    The grid is calculated once; what is stored derives from its rows. What an interrupted write has left is completed.
    """
    grid, _ = staged(run.grid, "grid")
    run = from_grid(grid, weights, allow_partial, F.date_sub("observation_date", 1) if previous_date is None else previous_date)
    results, _ = staged(stores.result_rows(run.national, run.checksums(), version, at), "results")
    routes = stores.route_rows(run.grid, run.contributions, weights, version, at)
    events = signals.event_rows(signals.detect_anomalies(run.grid.filter("index_value is not null")), source).withColumn("event_timestamp", at)
    report.add(intelligence_events_stored=stores.append_new(events, f"{root}/{EVENTS}", EVENT_SCHEMA, EVENT_KEY))
    if in_place:
        report.add(route_indices_stored=stores.replace_days(routes, f"{root}/{ROUTE_RESULTS}"))
        report.add(index_results_stored=stores.replace_days(results, f"{root}/{RESULTS}"))
    else:
        report.add(route_indices_stored=stores.append_new(routes, f"{root}/{ROUTE_RESULTS}", ROUTE_INDICES, (*stores.RESULT_KEY, "route")))
        report.add(index_results_stored=stores.append_new(results, f"{root}/{RESULTS}", INDEX_RESULTS, stores.RESULT_KEY))
    # The latest date has one row for each window.
    last = results.filter(F.col("observation_date") == results.agg(F.max("observation_date")).scalar()).collect()
    if last:
        report.observation_date, report.calculation_version = last[0].observation_date, last[0].calculation_version
        report.execution_checksum = last[0].execution_checksum
        report.national_indices = {r.booking_window: float(r.index_value) for r in last if r.index_value is not None}
    report.run = run
    return run


def run_live(
    spark: SparkSession, raw_by_day, root: str, day: dt.date, calculated_at: dt.datetime, version: str | None = None,
    weights: DataFrame | None = None, weight_version: str | None = None, source: str = "LIVE", quote_source: str | None = None,
    reference: DataFrame | None = None,
) -> Report:
    """Incremental run for one day; ``version`` is the time of the run, so a day may be calculated again.

    ``raw_by_day(date)`` gives the raw quotes of a date; with ``quote_source`` only stored quotes of that canonical source are paired. Without
    stored valid quotes of the day before, that day is cleaned and stored first and the base rows are seeded (cold start). ``reference``
    months that are new are loaded. A known version is refused before anything is written. Observations, routes, quality rows and events are
    appended by key and the results last, so a run that failed half-way can be repeated; what it left is invisible until then.
    """
    weights = resolve_weights(spark, weights, weight_version)
    version = calculated_at.strftime("%Y%m%d%H%M%S") if version is None else version
    before = day - dt.timedelta(days=1)
    path = lambda name: f"{root}/{name}"
    at = F.lit(calculated_at)
    report = Report("LIVE", previous_date=before, historical_days=1)

    def day_rows(date):
        stored = stores.read_table(spark, path(OBSERVATIONS), STORED_FARES)
        rows = stored.filter(F.col("observation_date") == F.lit(date))
        return quotes.stored_to_observations(rows if quote_source is None else rows.filter(F.col("source") == quote_source))

    key = [(F.lit(day).alias("observation_date"), F.lit(w).alias("booking_window")) for w in K.WINDOWS]
    planned = spark.range(1).select(F.inline(F.array(*[F.struct(*k, F.lit(f"CALC_{day.isoformat()}_{version}").alias("calculation_version")) for k in key])))
    stores.refuse_known(planned, path(RESULTS))
    if reference is not None:
        report.add(reference_records=stores.load_reference(reference, path(REFERENCE)))
    basket = weights.select("route")
    report.cold_start = day_rows(before).isEmpty()
    if report.cold_start:
        report.historical_days = 2
        ingest(spark, raw_by_day(before), root, report, F.lit(calculated_at - dt.timedelta(days=1)), basket)
        if stores.read_table(spark, path(RESULTS), INDEX_RESULTS).filter(F.col("observation_date") == F.lit(before)).isEmpty():
            of_day = F.lit(dt.datetime.combine(before, calculated_at.time()))
            n, m = stores.seed_base_day(weights, F.lit(before), path(RESULTS), path(ROUTE_RESULTS), of_day, F.lit(f"OBS_{before.isoformat()}"))
            report.add(index_results_stored=n, route_indices_stored=m)
    ingest(spark, raw_by_day(day), root, report, at, basket)
    # Yesterday's route indices of finished runs only.
    stored = readside.finished(stores.read_table(spark, path(ROUTE_RESULTS), ROUTE_INDICES), stores.read_table(spark, path(RESULTS), INDEX_RESULTS))
    yesterday = stored.filter(F.col("observation_date") == F.lit(before))
    run = daily_index(day_rows(day), day_rows(before), F.lit(day), F.lit(before), weights, allow_partial=True, stored_previous=yesterday)
    store_run(spark, run, weights, root, report, version, at, source, previous_date=F.lit(before))
    report.add(routes_processed=stores.read_table(spark, path(ROUTES), stores.ROUTES_SCHEMA).count())
    report.observation_date = day
    return report


def run_day(
    spark: SparkSession, raw_by_day, root: str, day: dt.date, calculated_at: dt.datetime, version: str | None = None,
    weights: DataFrame | None = None, weight_version: str | None = None, source: str = "LIVE",
) -> tuple[IndexRun, int, bool]:
    """``run_live`` without its report: the run, rows stored and the cold flag."""
    report = run_live(spark, raw_by_day, root, day, calculated_at, version, weights, weight_version, source)
    return report.run, report.figures.get("observations_stored", 0), report.cold_start


def run_fixed_base(
    spark: SparkSession, raw: DataFrame, root: str, calculated_at: dt.datetime, weights: DataFrame | None = None,
    weight_version: str | None = None, seed_base: bool = False, source: str = "MOCK", report: Report | None = None,
) -> IndexRun:
    """Rerunnable run over a whole batch against its first day; replaces the dates it writes.

    With ``seed_base`` the first day gets its base rows, index 100. Events carry the time of the run, so those of an earlier run of the
    same dates are hidden with its results (``readside.finished_events``). Figures go to ``report``.
    """
    report = Report("SYNTHETIC") if report is None else report
    report.mode = "SYNTHETIC"
    weights = resolve_weights(spark, weights, weight_version)
    at = F.lit(calculated_at)
    ingest(spark, raw, root, report, at, weights.select("route"), in_place=True)
    # The stored, cleaned table cuts the lineage: the calculation starts from files, not from the raw scan.
    fares = quotes.stored_to_observations(stores.read_table(spark, f"{root}/{OBSERVATIONS}", STORED_FARES))
    first, report.historical_days = fares.agg(F.min("observation_date"), F.count_distinct("observation_date")).first()
    report.historical_days = max(0, report.historical_days - 1)
    if first is None:
        return fixed_base_index(fares, weights)
    base = F.lit(first)
    report.previous_date = first
    if seed_base:
        results, routes = stores.base_day_tables(weights, base, at)
        report.add(route_indices_stored=stores.replace_days(routes, f"{root}/{ROUTE_RESULTS}"),
                   index_results_stored=stores.replace_days(results, f"{root}/{RESULTS}"))
    run = store_run(spark, fixed_base_index(fares, weights, base), weights, root, report, "FIXED", at, source, in_place=True, previous_date=base)
    report.add(routes_processed=stores.read_table(spark, f"{root}/{ROUTES}", stores.ROUTES_SCHEMA).count())
    return run


def open_transitions(spark: SparkSession, root: str, version: str, start: dt.date | None = None, end: dt.date | None = None) -> tuple[list[dt.date], list[str]]:
    """Dates with quotes on the day before whose results of this version are not complete, and a warning for each gap.

    The stored results are the manifest: a date is finished when it has a result for every window. Dates are one for each calendar day.
    """
    stored = readside.read_filter(stores.read_table(spark, f"{root}/{OBSERVATIONS}", STORED_FARES), str(start) if start else None, str(end) if end else None)
    days = sorted(r[0] for r in stored.filter("quality_status = 'VALID'").select("observation_date").distinct().collect())
    mine = F.concat(F.lit("CALC_"), F.col("observation_date").cast("string"), F.lit("_" + version))
    done = stores.read_table(spark, f"{root}/{RESULTS}", INDEX_RESULTS).filter(F.col("calculation_version") == mine)
    done = done.groupBy("observation_date").agg(F.count_distinct("booking_window").alias("n")).filter(F.col("n") == len(K.WINDOWS))
    complete = {r[0] for r in done.select("observation_date").collect()}
    one = dt.timedelta(days=1)
    warnings = [f"Missing historical dates between {a.isoformat()} and {b.isoformat()}; no cross-gap calculation created."
                for a, b in zip(days, days[1:]) if b - a > one]
    return [b for a, b in zip(days, days[1:]) if b - a == one and b not in complete], warnings


def run_history(
    spark: SparkSession, root: str, version: str, calculated_at: dt.datetime, start: dt.date | None = None, end: dt.date | None = None,
    weights: DataFrame | None = None, weight_version: str | None = None, allow_partial: bool = True, days_per_step: int = 31, source: str = "MOCK",
) -> Report:
    """Every day-to-day transition of the stored observations, in steps of some days; goes on where an earlier run of the version stopped.

    A step calculates all its transitions at once from the dates it needs (two earlier ones, for the pairs and the previous index of its first
    date), so steps of any size and any interruption give the same rows. Each writes events and routes by key and its results last. A date
    without quotes on the day before has no transition; the first one after it has no previous index and so no events.
    """
    if days_per_step < 1:
        raise ValueError("days_per_step must be at least 1")
    weights = resolve_weights(spark, weights, weight_version)
    todo, warnings = open_transitions(spark, root, version, start, end)
    report = Report("HISTORY", historical_days=len(todo), warnings=warnings)
    at = F.lit(calculated_at)
    for i in range(0, len(todo), days_per_step):
        step = todo[i : i + days_per_step]
        low = step[0] - dt.timedelta(days=2)
        stored = stores.read_table(spark, f"{root}/{OBSERVATIONS}", STORED_FARES)
        fares = quotes.stored_to_observations(readside.read_filter(stored, str(max(low, start) if start else low), str(step[-1])))
        run = historical_index(fares, weights, allow_partial=allow_partial)
        grid = run.grid.filter(F.col("observation_date").isin(step))
        store_run(spark, replace(run, grid=grid), weights, root, report, version, at, source, allow_partial=allow_partial)
        report.previous_date = step[-1] - dt.timedelta(days=1)
    return report
