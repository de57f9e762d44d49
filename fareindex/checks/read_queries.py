"""Registered queries: read side, stored tables, incremental and streaming ingest."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.local import small_table
from ..operators import cleaning as cl, index as ix, readside as rs
from ..plans import jobs
from ..schemas import INDEX_RESULTS, QUALITY_METRICS, ROUTE_INDICES, STORED_FARES
from ..session import work_dir
from ..sources import cpi, quotes, stores, testdata as td
from ..streaming import ingest
from . import frames as fr
from .cleaning_queries import CHECKSUM_SQL
from .index_queries import SL3, quality_metrics
from .registry import D, R, TS, cte, query
from .tables import national

cte("codes", "SELECT DISTINCT route FROM obs")

# ----------------------------------------------------------------- read side

CURRENT = "observation_date, booking_window, index_value, calculation_timestamp, lag(index_value) OVER (PARTITION BY booking_window ORDER BY observation_date) AS p"


@query("q1_current_index", f"""SELECT {D('observation_date')}, booking_window, {R('index_value')}, {R('p', 'previous_index')}, {R('(index_value - p) / p * 100', 'change_percent')} FROM (SELECT {CURRENT} FROM latest)
ORDER BY observation_date DESC, booking_window = 'T+15' DESC, calculation_timestamp DESC LIMIT 1""")
def _(spark, sf):
    return rs.current_index(fr.results(spark, sf)).select("observation_date", "booking_window", "index_value", "previous_index", "change_percent")


@query("q2_index_history", f"SELECT {D('observation_date')}, booking_window, {R('index_value')}, calculation_version FROM latest WHERE observation_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25'")
def _(spark, sf):
    return rs.index_history(fr.results(spark, sf), "2024-01-10", "2024-01-25").select("observation_date", "booking_window", "index_value", "calculation_version")


@query("q3_latest_route_index", f"""SELECT route, {D('observation_date')}, booking_window, {R('index_value')}, {R('p', 'previous_index')}, {R('(index_value - p) / p * 100', 'change_percent')}, {R('weight')}, {R('contribution')}
FROM (SELECT *, lag(index_value) OVER (PARTITION BY route, booking_window ORDER BY observation_date) AS p FROM latest_routes WHERE booking_window = 'T+7') QUALIFY row_number() OVER (PARTITION BY route ORDER BY observation_date DESC) = 1""")
def _(spark, sf):
    return rs.latest_route_index(fr.route_results(spark, sf), "T+7").select(
        "route", "observation_date", "booking_window", "index_value", "previous_index", "change_percent", "weight", "contribution"
    )


cte("chosen", "SELECT observation_date, booking_window, calculation_version FROM results WHERE status = 'SUCCESS' ORDER BY booking_window = 'T+15' DESC, observation_date DESC, calculation_timestamp DESC, booking_window LIMIT 1")
cte("ranking", """
SELECT route, coalesce(weight, 0.1) AS weight, coalesce(index_value, 100) AS route_index, coalesce(weight, 0.1) * coalesce(index_value, 100) AS lvl,
  coalesce(contribution, round_even(coalesce(weight, 0.1) * (coalesce(index_value, 100) - 100), 2)) AS pt, coalesce(contribution, 0) AS st FROM route_results JOIN chosen USING (observation_date, booking_window, calculation_version)
""")


@query("q4_contribution_ranking", f"""SELECT route, {R('weight')}, {R('route_index')}, {R('round_even(lvl, 2)', 'level_contribution')}, {R('pt', 'point_contribution')},
  {R('CASE WHEN sum(st) OVER () <> 0 THEN round_even(pt / sum(st) OVER () * 100, 1) ELSE 0 END', 'percentage_share_of_change')} FROM ranking""")
def _(spark, sf):
    return rs.contribution_ranking(fr.results(spark, sf), fr.route_results(spark, sf))


@query("q5_route_list", "SELECT route, substr(route, 1, 3) AS origin, substr(route, 5, 3) AS destination, TRUE AS active FROM codes ORDER BY route")
def _(spark, sf):
    return rs.list_routes(fr.routes(spark, sf))


PIVOT = ", ".join(f"round_even(coalesce(arg_max(index_value, (r.observation_date, r.calculation_timestamp)) FILTER (r.booking_window = '{w}'), 100), 1) + 0.0 AS \"{w}\"" for w in K.WINDOWS)


@query("q6_route_window_matrix", f"""SELECT c.route, {PIVOT} FROM codes c LEFT JOIN (SELECT r.* FROM route_results r JOIN results n USING (observation_date, booking_window, calculation_version) WHERE n.status = 'SUCCESS') r ON r.route = c.route GROUP BY c.route""")
def _(spark, sf):
    return rs.route_window_matrix(fr.routes(spark, sf), fr.results(spark, sf), fr.route_results(spark, sf))


SIDE = ", ".join(f"max(index_value) FILTER (booking_window = '{w}') + 0.0 AS \"{w}\"" for w in K.WINDOWS)


@query("q7_window_comparison", f"SELECT {D('observation_date')}, {SIDE} FROM latest GROUP BY observation_date")
def _(spark, sf):
    return rs.window_comparison(fr.results(spark, sf))


@query("q8_last_points", f"SELECT {D('observation_date')}, {R('index_value')} FROM latest WHERE booking_window = 'T+15' ORDER BY observation_date DESC LIMIT 7")
def _(spark, sf):
    return rs.last_points(fr.results(spark, sf), 7).select("observation_date", "index_value")


@query("q8_point_range", "SELECT CAST(floor(min(v) - 2) AS BIGINT) AS low, CAST(ceil(max(v) + 2) AS BIGINT) AS high FROM (SELECT coalesce(index_value, 100) AS v FROM latest WHERE booking_window = 'T+15' ORDER BY observation_date DESC LIMIT 30)")
def _(spark, sf):
    return rs.point_range(rs.last_points(fr.results(spark, sf), 30))


@query("q9_pressure_ranking", """SELECT CAST(row_number() OVER (ORDER BY score DESC, route) AS INT) AS rank, route, score, CASE WHEN score >= 75 THEN 'HIGH_PRESSURE' WHEN score >= 50 THEN 'MODERATE_PRESSURE' ELSE 'NORMAL' END AS status, trend
FROM (SELECT route, CAST(floor(max(p) + 0.5) AS INT) AS score, arg_max(reason, (p, observation_date, booking_window)) AS trend FROM (SELECT *, round_even(pressure_score, 4) AS p FROM events_out) GROUP BY route) ORDER BY score DESC, route LIMIT 5""")
def _(spark, sf):
    return rs.pressure_ranking(fr.events(spark, sf))


@query("q10_sort_routes", f"SELECT route, {D('observation_date')}, {R('index_value')} FROM latest_routes WHERE booking_window = 'T+7' ORDER BY coalesce(index_value, 0) DESC, route")
def _(spark, sf):
    rows = rs.latest_runs(fr.route_results(spark, sf).filter("booking_window = 'T+7'"), ("route", "booking_window", "observation_date"))
    return rs.sort_routes(rows, "index").select("route", "observation_date", "index_value")


@query("q11_list_events", f"SELECT {D('observation_date')}, route, booking_window, event_type, {R('round_even(anomaly_score, 4)', 'anomaly_score')} FROM events_out WHERE event_type = 'AIRFARE_SHOCK'")
def _(spark, sf):
    return rs.list_events(fr.events(spark, sf), shocks_only=True).select(*SL3, "event_type", "anomaly_score")


@query("q12_list_quality", f"SELECT {D('metric_date')}, source, CAST(observation_count AS BIGINT) AS observation_count, {TS('generated_at')} FROM qmetrics WHERE source = 'YATRA'")
def _(spark, sf):
    return rs.list_quality(quality_metrics(spark, sf), source="YATRA").select("metric_date", "source", "observation_count", "generated_at")


@query("q13_run_status", f"SELECT 'ACTIVE' AS status, {D('observation_date', 'latest_observation_date')}, booking_window AS latest_booking_window, {R('index_value', 'latest_index_value')}, calculation_version FROM results ORDER BY observation_date DESC, calculation_timestamp DESC, booking_window LIMIT 1")
def _(spark, sf):
    return rs.run_status(fr.results(spark, sf)).drop("calculation_timestamp", "execution_checksum")


cte("now_index", "SELECT index_value AS cur FROM results WHERE status = 'SUCCESS' ORDER BY observation_date DESC, calculation_timestamp DESC, booking_window DESC LIMIT 1")
cte("whatif", "SELECT c.route, CAST(count(*) % 50 AS DOUBLE) AS shock_percent, coalesce(max(w.weight), 0.10) AS weight FROM obs c LEFT JOIN wide w ON w.route = c.route GROUP BY c.route")


@query("q14_simulate", f"""SELECT route, {R('shock_percent')}, {R('cur', 'current_index')}, {R('round_even(cur + round_even(cur * weight * shock_percent / 100, 4), 4)', 'projected_index')}, {R('round_even(cur * weight * shock_percent / 100, 4)', 'impact_points')}, 'SIMULATED' AS status FROM whatif, now_index""")
def _(spark, sf):
    scenarios = td.index_observations(spark, sf).groupBy("route").agg((F.count(F.lit(1)) % 50).cast("double").alias("shock_percent"))
    return rs.simulate(scenarios, fr.results(spark, sf), fr.wide_weights(spark))


# -------------------------------------------------------------- stored tables

cte("stored", "SELECT route, day AS observation_date, canonical AS source, quality_status, round(fare, 2) AS comparable_fare, fingerprint, observation_timestamp, win FROM cleaned WHERE quality_status <> 'EXCLUDED'")
STORED_COUNTS = f"SELECT {D('observation_date')}, source, count(*) AS rows, {R('sum(CAST(comparable_fare AS DECIMAL(18, 2)))', 'fares')}, 0 AS added_by_rerun FROM stored GROUP BY observation_date, source"


def _counts(stored: DataFrame, again: int) -> DataFrame:
    return stored.groupBy("observation_date", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("comparable_fare").alias("fares")).withColumn(
        "added_by_rerun", F.lit(again)
    )


@query("k1_persist_observations", STORED_COUNTS)
def _(spark, sf):
    path = work_dir(spark, "fares")
    rows = fr.cleaned(spark, sf).observations
    stores.persist_observations(rows, path)
    return _counts(stores.read_table(spark, path, STORED_FARES), stores.persist_observations(rows, path))


@query("k1_null_timestamps", STORED_COUNTS.replace("FROM stored", "FROM (SELECT day AS observation_date, canonical AS source, round(fare, 2) AS comparable_fare FROM cleaned WHERE quality_status <> 'EXCLUDED' AND ingest_seq % 10 <> 0)"))
def _(spark, sf):
    path = work_dir(spark, "fares")
    rows = fr.cleaned(spark, sf).observations
    rows = rows.withColumn("observation_timestamp", F.when(F.col("ingest_seq") % 10 != 0, F.col("observation_timestamp")))
    stores.persist_observations(rows, path)
    return _counts(stores.read_table(spark, path, STORED_FARES), stores.persist_observations(rows, path))


@query("s9_read_stored_observations", f"SELECT route, win AS booking_window, {R('comparable_fare')}, {TS('observation_timestamp')} FROM stored WHERE observation_date = DATE '2024-01-05' AND source = 'YATRA' AND quality_status = 'VALID'")
def _(spark, sf):
    path = work_dir(spark, "fares")
    stores.persist_observations(fr.cleaned(spark, sf).observations, path)
    return quotes.read_stored_observations(spark, path, "2024-01-05", "YATRA").select("route", "booking_window", "comparable_fare", "observation_timestamp")


@query("k2_missing_routes", "SELECT route AS code, substr(route, 1, 3) AS origin, substr(route, 5, 3) AS destination, TRUE AS active FROM codes WHERE substr(route, 1, 3) <> 'DEL'")
def _(spark, sf):
    obs = td.index_observations(spark, sf)
    known = stores.missing_routes(obs, small_table(spark, [], stores.ROUTES_SCHEMA)).filter("origin = 'DEL'")
    return stores.missing_routes(obs, known)


@query("k3_conflicting_results", f"SELECT {D('observation_date')}, booking_window, calculation_version FROM results WHERE calculation_version LIKE '%B'")
def _(spark, sf):
    rows = fr.results(spark, sf)
    return stores.conflicting_results(rows, rows.filter("calculation_version like '%B'")).select("observation_date", "booking_window", "calculation_version")


@query("k4_route_rows", f"SELECT {D('g.observation_date', 'observation_date')}, g.booking_window, g.route, {R('round_even(g.index_value, 4)', 'index_value')}, g.status, {R('w.weight', 'weight')}, {R('round_even(coalesce(c.point_contribution, c.level_contribution), 4)', 'contribution')} FROM grid g LEFT JOIN demo w ON w.route = g.route LEFT JOIN nat_contrib c ON c.observation_date = g.observation_date AND c.route = g.route AND c.booking_window = g.booking_window")
def _(spark, sf):
    run = fr.history(spark, sf)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return stores.route_rows(run.grid, run.contributions, ix.demo_weights(spark), "A", at).drop("calculation_version", "calculation_timestamp")


@query("k4_result_rows", f"SELECT {D('observation_date')}, booking_window, {R('round_even(national_index, 4)', 'index_value')}, status, 'CALC_' || CAST(observation_date AS VARCHAR) || '_A' AS calculation_version, '{K.DEMO_WEIGHT_VERSION}' AS weight_version FROM nat")
def _(spark, sf):
    run = fr.history(spark, sf)
    rows = stores.result_rows(run.national, run.checksums(), "A", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rows.select("observation_date", "booking_window", "index_value", "status", "calculation_version", "weight_version")


@query("k5_base_day_rows", f"SELECT {D('b', 'observation_date')}, booking_window, route, 'CALC_' || CAST(b AS VARCHAR) || '_BASE' AS calculation_version, 100.0::DOUBLE AS index_value, {R('weight')}, 0.0::DOUBLE AS contribution FROM base_day, windows, demo")
def _(spark, sf):
    first = td.index_observations(spark, sf).agg(F.min("observation_date")).scalar()
    return ix.base_day_rows(ix.demo_weights(spark), first).drop("status")


@query("k6_load_reference", "SELECT count(*) AS months, CAST(count(*) AS BIGINT) AS added, CAST(0 AS BIGINT) AS added_by_rerun FROM cpi")
def _(spark, sf):
    path = work_dir(spark, "reference")
    series = cpi.require_rows(cpi.national_series(td.cpi_sheet(spark, sf)))
    first, second = stores.load_reference(series, path), stores.load_reference(series, path)
    return stores.read_table(spark, path, stores.CPI_SCHEMA).agg(F.count(F.lit(1)).alias("months")).withColumns(
        {"added": F.lit(first).cast("bigint"), "added_by_rerun": F.lit(second).cast("bigint")}
    )


@query("k7_append_checked", """SELECT route, count(*) AS rows FROM (SELECT o || '-' || d AS route FROM assessed WHERE o <> '' AND d <> '' AND n_airline <> '' AND canonical IS NOT NULL
  AND NOT coalesce(b < 0, FALSE) AND fare IS NOT NULL AND win IS NOT NULL AND excluded_reason IS NULL) GROUP BY 1""")
def _(spark, sf):
    path = work_dir(spark, "ingested")
    stores.append_checked(cl.normalize(td.flawed_quotes(spark, sf)), path)
    return stores.read_table(spark, path, STORED_FARES).groupBy("route").agg(F.count(F.lit(1)).alias("rows"))


@query("k8_replace_days", f"SELECT {D('observation_date')}, booking_window, {R('index_value')} FROM results WHERE calculation_version LIKE '%B' OR (calculation_version LIKE '%A' AND day(observation_date) % 3 <> 0)")
def _(spark, sf):
    path = work_dir(spark, "replaced")
    rows = fr.results(spark, sf).drop("execution_checksum")
    stores.replace_days(rows.filter("calculation_version like '%A'"), path)
    stores.replace_days(rows.filter("calculation_version like '%B'"), path)
    return spark.read.parquet(path).select("observation_date", "booking_window", "index_value")


# ------------------------------------------------------- incremental, streaming

cte("two_days", "SELECT *, route || '_' || win || '_' || concat_ws('|', n_airline, n_flight_number, n_departure_time, n_cabin_class, n_fare_type, n_baggage_characteristics) AS product FROM cleaned WHERE quality_status = 'VALID' AND day IN (DATE '2024-01-14', DATE '2024-01-15')")
cte("live_elem", """SELECT c.route, c.win AS booking_window, exp(avg(ln(c.f / p.f))) * 100 AS index_value FROM
(SELECT route, win, product, min(round(fare, 2)) AS f FROM two_days WHERE day = DATE '2024-01-15' GROUP BY ALL) c JOIN (SELECT product, min(round(fare, 2)) AS f FROM two_days WHERE day = DATE '2024-01-14' GROUP BY ALL) p ON p.product = c.product GROUP BY ALL""")
LIVE = f"""SELECT e.booking_window, {R('round_even(sum(w.weight * e.index_value) / sum(w.weight), 4)', 'index_value')} FROM live_elem e JOIN demo w ON w.route = e.route GROUP BY 1 HAVING sum(w.weight) >= 0.5"""


AT = dt.datetime(2024, 1, 15, 23, 0, 0)

# Every transition of the stored, valid quotes, as the jobs see them: fares in cents.
cte("held", "SELECT *, route || '_' || win || '_' || concat_ws('|', n_airline, n_flight_number, n_departure_time, n_cabin_class, n_fare_type, n_baggage_characteristics) AS product, round(fare, 2) AS cents FROM cleaned WHERE quality_status = 'VALID'")
cte("held_best", "SELECT day, route, win, product, min(cents) AS f FROM held GROUP BY ALL")
cte("held_elem", """SELECT c.day, c.route, c.win, exp(avg(ln(c.f / p.f))) * 100 AS index_value FROM held_best c JOIN held_best p ON p.product = c.product AND p.day = c.day - 1 GROUP BY ALL""")
cte("held_sizes", "SELECT day, route, win, count(*) AS n FROM held GROUP BY ALL")
cte("held_seen", "SELECT DISTINCT t.day, s.route FROM (SELECT DISTINCT day FROM held WHERE day - 1 IN (SELECT day FROM held)) t JOIN held_sizes s ON s.day IN (t.day, t.day - 1)")
cte("held_grid0", """SELECT s.day AS observation_date, s.route, w.booking_window, e.index_value, CASE WHEN e.index_value IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS status,
  coalesce(c.n, 0) AS num_current_observations, coalesce(p.n, 0) AS num_previous_observations FROM held_seen s CROSS JOIN windows w
LEFT JOIN held_elem e ON e.day = s.day AND e.route = s.route AND e.win = w.booking_window LEFT JOIN held_sizes c ON c.day = s.day AND c.route = s.route AND c.win = w.booking_window
LEFT JOIN held_sizes p ON p.day = s.day - 1 AND p.route = s.route AND p.win = w.booking_window""")
cte("held_grid", "SELECT g.*, y.index_value AS previous_index FROM held_grid0 g LEFT JOIN (SELECT observation_date + 1 AS observation_date, route, booking_window, index_value FROM held_grid0) y USING (observation_date, route, booking_window)")
# The live day starts from the base day, whose routes stand at 100.
cte("live_grid", "SELECT g.* REPLACE (CASE WHEN d.route IS NOT NULL THEN 100.0::DOUBLE END AS previous_index) FROM held_grid g LEFT JOIN demo d USING (route) WHERE observation_date = DATE '2024-01-15'")
national("live", "live_grid", "demo", True)
national("hist", "held_grid", "demo", True)


def stored_sql(grid: str, nat: str, version: str) -> str:
    """Result, route and event rows of a stored calculation in one layout."""
    return f"""
SELECT 'result' AS kind, {D('n.observation_date', 'day')}, n.booking_window AS win, '' AS item, {R('round_even(n.national_index, 4)', 'v1')}, NULL::DOUBLE AS v2,
  n.status || ' CALC_' || CAST(n.observation_date AS VARCHAR) || '_{version} ' || c.execution_checksum AS note FROM {nat} n JOIN ({CHECKSUM_SQL.replace('FROM nat GROUP', f'FROM {nat} GROUP').replace('FROM grid GROUP', f'FROM {grid} GROUP')}) c ON c.observation_date = CAST(n.observation_date AS VARCHAR)
UNION ALL SELECT 'route', {D('g.observation_date', 'day')}, g.booking_window, g.route, {R('round_even(g.index_value, 4)', 'v1')}, {R('round_even(coalesce(c.point_contribution, c.level_contribution), 4)', 'v2')}, g.status
  FROM {grid} g LEFT JOIN {nat}_contrib c ON c.observation_date = g.observation_date AND c.route = g.route AND c.booking_window = g.booking_window
UNION ALL SELECT 'event', {D('observation_date', 'day')}, booking_window, route, {R('round_even(s, 4)', 'v1')}, {R('round_even(least(100, s * 10 + 35), 4)', 'v2')}, CASE WHEN s >= 4 THEN 'AIRFARE_SHOCK' ELSE 'ANOMALY' END
  FROM (SELECT *, abs((index_value - previous_index) / previous_index * 100) AS s FROM {grid}) WHERE s >= 2"""


def stored_tables(spark, root) -> list[DataFrame]:
    """What ``stored_sql`` lists, read back."""
    number = lambda c: F.col(c).cast("double")
    layout = lambda df, kind, day, win, item, v1, v2, note: df.select(
        F.lit(kind).alias("kind"), F.col(day).alias("day"), win.alias("win"), item.alias("item"), v1.cast("double").alias("v1"), v2.cast("double").alias("v2"), note.alias("note"))
    results = stores.read_table(spark, f"{root}/{jobs.RESULTS}", INDEX_RESULTS)
    routes = rs.finished(stores.read_table(spark, f"{root}/{jobs.ROUTE_RESULTS}", ROUTE_INDICES), results)
    events = rs.finished_events(stores.read_table(spark, f"{root}/{jobs.EVENTS}", jobs.EVENT_SCHEMA), results)
    none, empty = F.lit(None), F.lit("")
    return [
        layout(results, "result", "observation_date", F.col("booking_window"), empty, number("index_value"), none, F.concat_ws(" ", "status", "calculation_version", "execution_checksum")),
        layout(routes, "route", "observation_date", F.col("booking_window"), F.col("route"), number("index_value"), number("contribution"), F.col("status")),
        layout(events, "event", "observation_date", F.col("booking_window"), F.col("route"), number("anomaly_score"), number("pressure_score"), F.col("event_type")),
        layout(stores.read_table(spark, f"{root}/{jobs.QUALITY}", QUALITY_METRICS), "quality", "metric_date", empty, F.col("source"), number("observation_count"), number("route_coverage"),
               F.concat_ws(" ", "freshness_minutes", "missing_observations", "invalid_observations", "anomalous_valid_observations", "status")),
        layout(stores.read_table(spark, f"{root}/{jobs.ROUTES}", stores.ROUTES_SCHEMA).withColumn("day", F.lit(None).cast("date")), "dimension", "day", empty, F.col("code"), none, none, F.concat_ws(" ", "origin", "destination")),
    ]


def _live(spark, sf, root) -> jobs.Report:
    raw = td.flawed_quotes(spark, sf)
    by_day = lambda day: raw.filter(cl.observation_day() == F.lit(day))
    series = cpi.require_rows(cpi.national_series(td.cpi_sheet(spark, sf)))
    return jobs.run_live(spark, by_day, root, dt.date(2024, 1, 15), AT, reference=series)


@query("i1_incremental_day", LIVE)
def _(spark, sf):
    root = work_dir(spark, "live")
    _live(spark, sf, root)
    rows = stores.read_table(spark, f"{root}/{jobs.RESULTS}", INDEX_RESULTS).filter("observation_date = date'2024-01-15' and index_value is not null")
    return rows.select("booking_window", "index_value")


LIVE_DAYS = "(DATE '2024-01-14', DATE '2024-01-15')"


@query("i1_stored_tables", f"""{stored_sql('live_grid', 'live', '20240115230000')}
UNION ALL SELECT 'result', '2024-01-14', booking_window, '', 100.0, NULL, 'SUCCESS CALC_2024-01-14_BASE ' || repeat('0', 64) FROM windows
UNION ALL SELECT 'route', '2024-01-14', booking_window, route, 100.0, 0.0, 'SUCCESS' FROM windows, demo
UNION ALL SELECT 'quality', {D('metric_date', 'day')}, '', m.source, m.observation_count + 0.0, round(route_coverage, 4) + 0.0, CAST(floor(epoch(TIMESTAMP '2024-01-15 23:00:00' - to_days(CAST(DATE '2024-01-15' - metric_date AS INT)) - latest) / 60) AS BIGINT)
  || ' ' || missing_observations || ' ' || invalid_observations || ' ' || anomalous_valid_observations || ' COMPLETE'
  FROM qmetrics m JOIN (SELECT day, canonical AS source, max(observation_timestamp) AS latest FROM cleaned GROUP BY ALL) l ON l.day = m.metric_date AND l.source = m.source WHERE metric_date IN {LIVE_DAYS}
UNION ALL SELECT DISTINCT 'dimension', NULL, '', route, NULL::DOUBLE, NULL::DOUBLE, o || ' ' || d FROM cleaned WHERE day IN {LIVE_DAYS}""")
def _(spark, sf):
    root = work_dir(spark, "live")
    _live(spark, sf, root)
    return reduce(DataFrame.unionByName, stored_tables(spark, root))


LOST = "coalesce(raw_reason, normalize_error, excluded_reason) IS NOT NULL"


@query("i2_run_summary", f"""SELECT 'SUCCESS' AS status, 'LIVE' AS mode, 2 AS historical_days, TRUE AS cold_start, '2024-01-15' AS observation_date, '2024-01-14' AS previous_observation_date,
  'CALC_2024-01-15_20240115230000' AS calculation_version, (SELECT string_agg(booking_window || '=' || printf('%.4f', round_even(national_index, 4)), ',' ORDER BY booking_window) FROM live WHERE national_index IS NOT NULL) AS national_indices,
  (SELECT count(*) FROM assessed WHERE day IN {LIVE_DAYS}) AS total_processed, count(*) FILTER (quality_status <> 'EXCLUDED') AS observations_stored, count(*) FILTER (quality_status = 'VALID') AS valid_observations,
  count(*) FILTER (quality_status = 'OUTLIER') AS outlier_observations, count(*) FILTER (quality_status = 'EXCLUDED') AS duplicate_observations, (SELECT count(*) FROM assessed WHERE day IN {LIVE_DAYS} AND {LOST}) AS rejected_observations,
  count(DISTINCT route) AS routes_processed, 5 + (SELECT count(*) FROM live) AS index_results_stored, 30 + (SELECT count(*) FROM live_grid) AS route_indices_stored,
  (SELECT count(*) FROM live_grid WHERE abs((index_value - previous_index) / previous_index * 100) >= 2) AS intelligence_events_stored, (SELECT count(*) FROM qmetrics WHERE metric_date IN {LIVE_DAYS}) AS quality_metrics_stored,
  (SELECT count(*) FROM cpi) AS reference_records, (SELECT execution_checksum FROM ({CHECKSUM_SQL.replace('FROM nat GROUP', 'FROM live GROUP').replace('FROM grid GROUP', 'FROM live_grid GROUP')})) AS execution_checksum
FROM cleaned WHERE day IN {LIVE_DAYS}""")
def _(spark, sf):
    shown = F.transform(F.array_sort(F.map_entries("national_indices")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return _live(spark, sf, work_dir(spark, "live")).frame(spark).withColumn("national_indices", F.array_join(shown, ","))


@query("a8_resumed_history", stored_sql("held_grid", "hist", "H1"))
def _(spark, sf):
    root = work_dir(spark, "history")
    stores.persist_observations(fr.cleaned(spark, sf).observations, f"{root}/{jobs.OBSERVATIONS}")
    jobs.run_history(spark, root, "H1", AT, end=dt.date(2024, 1, 12))
    jobs.run_history(spark, root, "H1", AT, days_per_step=12)
    return reduce(DataFrame.unionByName, stored_tables(spark, root)[:3])


@query("i4_streaming_ingest", f"""SELECT {D('observation_date')}, source, count(*) AS rows, {R('sum(CAST(comparable_fare AS DECIMAL(18, 2)))', 'fares')}
FROM (SELECT day AS observation_date, canonical AS source, round(fare, 2) AS comparable_fare FROM accepted WHERE copy_no = 1) GROUP BY observation_date, source""")
def _(spark, sf):
    landing, table, checkpoint = (work_dir(spark, n) for n in ("landing", "fares", "stream"))
    td.flawed_quotes(spark, sf).write.parquet(landing)
    ingest.run_ingest(ingest.raw_stream(spark, landing, files_per_batch=4), table, checkpoint)
    stored = stores.read_table(spark, table, STORED_FARES)
    return stored.groupBy("observation_date", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("comparable_fare").alias("fares"))


@query("i4_batch_ledger", f"""SELECT (SELECT count(*) FROM flawed) AS rows, (SELECT count(*) FROM assessed WHERE {LOST}) AS rejected, (SELECT count(*) FROM accepted WHERE copy_no = 1) AS added, 0 AS added_by_second_feed""")
def _(spark, sf):
    landing, table = (work_dir(spark, n) for n in ("landing", "fares"))
    td.land(td.flawed_quotes(spark, sf), landing, 8)
    for feed in ("one", "two"):
        ingest.run_ingest(ingest.raw_stream(spark, landing, files_per_batch=4), table, work_dir(spark, "stream"), stream=feed)
    of = lambda name, feed: F.sum(F.when(F.col("stream") == feed, F.col(name)))
    return ingest.ledger(spark, table).agg(*[of(n, "one").alias(n) for n in ("rows", "rejected", "added")], of("added", "two").cast("int").alias("added_by_second_feed"))
