"""Registered queries: pairing, indices, quality, features, windows over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import finite
from ..operators import features, index as ix, pairing, quality as q, readside, signals
from ..plans import calculation as calc
from ..sources import testdata as td
from . import frames as fr
from .registry import D, L, R, cents, cte, query
from .tables import TEXTS, national

SL = f"{D('observation_date')}, route, booking_window"
SL3 = ("observation_date", "route", "booking_window")

# --------------------------------------------------------------------- joins


@query("j1_comparable_pairs", f"SELECT {SL}, fingerprint, {R('current_fare')}, {R('previous_fare')} FROM pairs")
def _(spark, sf):
    return pairing.matched_pairs(pairing.consecutive_products(td.index_observations(spark, sf))).drop("relative")


cte("dated", f"""
SELECT observation_date, route, booking_window, route || '_' || booking_window || '_' || substr(sha256(concat_ws('|', route, booking_window, {', '.join(TEXTS)},
  CAST(last_day(travel_date) AS VARCHAR))), 1, 16) AS fingerprint, min(comparable_fare) AS fare FROM obs GROUP BY ALL
""")


@query("j1_pairs_with_travel_date", f"""SELECT {D('c.observation_date', 'observation_date')}, c.fingerprint, {R('c.fare', 'current_fare')}, {R('p.fare', 'previous_fare')}
FROM dated c JOIN dated p ON p.observation_date = c.observation_date - 1 AND p.fingerprint = c.fingerprint""")
def _(spark, sf):
    # Departures are moved to the end of their month, so that a departure is quoted on more than one day.
    obs = td.index_observations(spark, sf).withColumn("travel_date", F.last_day("travel_date"))
    rows = pairing.matched_pairs(pairing.consecutive_products(obs, include_travel_date=True))
    return rows.select("observation_date", "fingerprint", "current_fare", "previous_fare")


@query("j2_pairing_diagnostics", f"""SELECT {D('coalesce(c.observation_date, p.observation_date + 1)', 'observation_date')}, coalesce(c.route, p.route) AS route, coalesce(c.booking_window, p.booking_window) AS booking_window,
  count(*) FILTER (c.fare IS NOT NULL AND p.fare IS NOT NULL) AS matched, count(*) FILTER (p.fare IS NULL) AS unmatched_current, count(*) FILTER (c.fare IS NULL) AS unmatched_previous,
  count(*) FILTER (c.quotes > 1 OR p.quotes > 1) AS duplicate_fingerprints
FROM best c FULL JOIN best p ON p.observation_date + 1 = c.observation_date AND p.fingerprint = c.fingerprint GROUP BY 1, 2, 3""")
def _(spark, sf):
    return pairing.pairing_diagnostics(pairing.consecutive_products(td.index_observations(spark, sf)))


@query("j2_duplicate_fingerprints", f"""SELECT {D('coalesce(c.observation_date, p.observation_date + 1)', 'observation_date')}, coalesce(c.fingerprint, p.fingerprint) AS fingerprint, coalesce(c.quotes, 0) AS current_quotes, coalesce(p.quotes, 0) AS previous_quotes
FROM best c FULL JOIN best p ON p.observation_date + 1 = c.observation_date AND p.fingerprint = c.fingerprint WHERE c.quotes > 1 OR p.quotes > 1""")
def _(spark, sf):
    rows = pairing.duplicate_fingerprints(pairing.consecutive_products(td.index_observations(spark, sf)))
    return rows.select("observation_date", "fingerprint", "current_quotes", "previous_quotes")


@query("j3_price_relatives", f"SELECT {SL}, fingerprint, {R('relative')} FROM pairs")
def _(spark, sf):
    return pairing.matched_pairs(pairing.consecutive_products(td.index_observations(spark, sf))).select(*SL3, "fingerprint", "relative")


@query("j4_route_weights", f"SELECT {SL}, {R('weight')} FROM natw_w")
def _(spark, sf):
    good = fr.history(spark, sf).grid.filter("status = 'SUCCESS'").select(*SL3)
    return ix.route_weight(good, fr.wide_weights(spark))


@query("j5_weight_coverage", f"SELECT {D('observation_date')}, booking_window, {R('coverage_ratio')}, {L('present_routes')}, {L('missing_routes')} FROM natw")
def _(spark, sf):
    return ix.weight_coverage(fr.history(spark, sf).grid, fr.wide_weights(spark))


@query("j8_source_movements", f"SELECT {SL}, source, {R('previous_fare')}, {R('current_fare')}, {R('percentage_change')}, direction FROM smoves")
def _(spark, sf):
    return signals.source_movements(signals.source_means(td.index_observations(spark, sf)))


cte("halves", "SELECT route, booking_window, source, comparable_fare, observation_date, observation_date >= DATE '2024-01-16' AS late FROM obs")


@query("j8_batch_movements", f"""SELECT route, booking_window, source, {D('max(observation_date) FILTER (late)', 'observation_date')}, {R('avg(comparable_fare) FILTER (late)', 'current_fare')}, {R('avg(comparable_fare) FILTER (NOT late)', 'previous_fare')}
FROM halves GROUP BY route, booking_window, source HAVING count(*) FILTER (late) > 0 AND count(*) FILTER (NOT late) > 0""")
def _(spark, sf):
    means = signals.source_means(td.index_observations(spark, sf))
    late = F.col("observation_date") >= F.lit("2024-01-16").cast("date")
    return signals.source_movements(means.filter(late), means.filter(~late)).select(*SL3, "source", "previous_fare", "current_fare")


cte("gridx", """
SELECT g.observation_date, g.route, g.booking_window, g.index_value, g.previous_index, (g.index_value - g.previous_index) / g.previous_index * 100 AS pct,
  (y.index_value - y.previous_index) / y.previous_index * 100 AS previous_change FROM grid g LEFT JOIN
  (SELECT observation_date + 1 AS observation_date, route, booking_window, index_value, previous_index FROM grid) y USING (observation_date, route, booking_window)
WHERE g.index_value > 0 AND g.previous_index > 0
""")
cte("baseline", "SELECT observation_date, route, booking_window, avg(comparable_fare) AS baseline FROM obs GROUP BY ALL")
cte("rquality", "SELECT day AS observation_date, route, win AS booking_window, max(quality_status) AS route_quality FROM cleaned GROUP BY ALL")
cte("moves", """
SELECT x.*, abs(pct) AS apct, pct - previous_change AS acceleration, CASE WHEN b.baseline > 0 THEN (index_value - b.baseline) / b.baseline * 100 END AS deviation,
  upper(coalesce(r.route_quality, 'VALID')) AS quality_status
FROM gridx x LEFT JOIN baseline b USING (observation_date, route, booking_window) LEFT JOIN rquality r USING (observation_date, route, booking_window)
""")


def shock_inputs(spark, sf, prepared):
    """Route movements with yesterday's movement, the mean fare as baseline, and the worst quality of the slice."""
    rows = signals.with_previous_change(prepared.run.grid)
    base = signals.facts_slices(prepared.facts).select(*SL3, "baseline")
    worst = fr.cleaned(spark, sf).observations.groupBy(*SL3).agg(F.max("quality_status").alias("route_quality"))
    return signals.shock_movements(rows, baseline=base, quality=worst)


@query("j9_movement_enrichment", f"SELECT {SL}, {R('pct', 'percentage_change')}, {R('acceleration')}, {R('deviation', 'historical_deviation')}, quality_status FROM moves")
def _(spark, sf):
    return shock_inputs(spark, sf, fr.prepared(spark, sf)).select(*SL3, "percentage_change", "acceleration", "historical_deviation", "quality_status")


@query("j10_route_star", f"""SELECT r.route, substr(r.route, 1, 3) AS origin, {D('r.observation_date', 'observation_date')}, r.booking_window, r.calculation_version, {R('r.index_value', 'index_value')}, {R('n.index_value', 'national_index')}, n.status AS national_status
FROM route_results r JOIN results n USING (observation_date, booking_window, calculation_version)""")
def _(spark, sf):
    rows = readside.route_star(fr.route_results(spark, sf), fr.routes(spark, sf), fr.results(spark, sf))
    return rows.select("route", "origin", "observation_date", "booking_window", "calculation_version", "index_value", "national_index", "national_status")


@query("j11_previous_result", f"SELECT route, booking_window, {D('observation_date')}, {R('lag(index_value) OVER (PARTITION BY route, booking_window ORDER BY observation_date)', 'previous_index')} FROM latest_routes")
def _(spark, sf):
    rows = readside.latest_runs(fr.route_results(spark, sf), ("route", "booking_window", "observation_date"))
    return readside.with_previous(rows, ("route", "booking_window")).select("route", "booking_window", "observation_date", "previous_index")


# ------------------------------------------------------------------- indices


@query("a1_jevons_index", f"SELECT {SL}, {R('gm', 'geometric_mean')}, n AS valid_pairs, {R('gm * 100', 'index_value')}, 'SUCCESS' AS status FROM elem")
def _(spark, sf):
    pairs = pairing.matched_pairs(pairing.consecutive_products(td.index_observations(spark, sf)))
    return ix.jevons(pairs, SL3)


@query("a2_elementary_slices", f"""SELECT {SL}, num_matched_pairs, num_current_observations, num_previous_observations, {R("CASE WHEN num_matched_pairs >= 3 THEN index_value END", 'index_value')},
  CASE WHEN num_matched_pairs >= 3 THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN num_matched_pairs < 3 THEN 'Matched pairs count (' || num_matched_pairs || ') is less than required minimum (3)' ELSE '' END AS warnings
FROM grid WHERE num_current_observations + num_previous_observations > 0""")
def _(spark, sf):
    rows = ix.elementary_slices(pairing.consecutive_products(td.index_observations(spark, sf)), min_pairs=3)
    return ix.calendar_transitions(rows).drop("geometric_mean")


@query("a3_route_grid", f"SELECT {SL}, {R('index_value')}, num_matched_pairs, num_current_observations, num_previous_observations, status, route_status FROM grid")
def _(spark, sf):
    return fr.history(spark, sf).grid.select(
        *SL3, "index_value", "num_matched_pairs", "num_current_observations", "num_previous_observations", "status", "route_status"
    )


NAT = f"{D('observation_date')}, booking_window, {R('national_index')}, {R('coverage_ratio')}, status, warnings"


@query("a4_national_index", f"SELECT {NAT}, '{K.DEMO_WEIGHT_VERSION}' AS weight_version FROM nat")
def _(spark, sf):
    return fr.history(spark, sf).national


@query("a4_national_strict", f"SELECT {NAT}, 'WIDE_V1' AS weight_version FROM nats")
def _(spark, sf):
    return fr.history(spark, sf, partial=False, wide=True).national


@query("a4_national_partial", f"SELECT {NAT}, 'WIDE_V1' AS weight_version FROM natw")
def _(spark, sf):
    return fr.history(spark, sf, wide=True).national


@query("a4_two_weight_versions", f"SELECT {NAT}, 'WIDE_V1' AS weight_version FROM natw")
def _(spark, sf):
    both = ix.demo_weights(spark).unionByName(fr.wide_weights(spark))
    return calc.historical_index(td.index_observations(spark, sf), both, allow_partial=True, weight_version="WIDE_V1").national


@query("a5_subbasket_weights", f"SELECT {SL}, {R('coalesce(CASE WHEN weight > 0 THEN weight ELSE 0 END / nullif(sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) OVER (PARTITION BY observation_date, booking_window), 0), 0)', 'weight')} FROM natw_w")
def _(spark, sf):
    rows = ix.observed_weights(fr.history(spark, sf).grid, fr.wide_weights(spark))
    return rows.select(*SL3, F.col("subbasket_weight").alias("weight"))


CONTRIB = f"{SL}, {R('weight')}, {R('index_value', 'route_index')}, {R('level_contribution')}, {R('point_contribution')}, {R('percentage_share_of_change')}"


@query("a6_contributions", f"SELECT {CONTRIB} FROM nat_contrib")
def _(spark, sf):
    return fr.history(spark, sf).contributions.drop("previous_index")


@query("a6_contributions_partial", f"SELECT {CONTRIB} FROM natw_contrib")
def _(spark, sf):
    return fr.history(spark, sf, wide=True).contributions.drop("previous_index")


@query("a7_daily_calculation", f"""SELECT {D('n.observation_date', 'observation_date')}, n.booking_window, {R('n.national_index', 'national_index')}, {R('n.coverage_ratio', 'coverage_ratio')}, n.status, c.routes, {R('c.points', 'point_change')}
FROM nat n LEFT JOIN (SELECT observation_date, booking_window, count(*) AS routes, sum(point_contribution) AS points FROM nat_contrib GROUP BY 1, 2) c USING (observation_date, booking_window)""")
def _(spark, sf):
    run = fr.history(spark, sf)
    key = ["observation_date", "booking_window"]
    points = run.contributions.groupBy(*key).agg(F.count(F.lit(1)).alias("routes"), F.sum("point_contribution").alias("point_change"))
    return run.national.drop("warnings", "weight_version").join(points, key, "left")


@query("a7_one_transition", f"SELECT {D('observation_date')}, booking_window, {R('national_index')}, status FROM nat WHERE observation_date = DATE '2024-01-15'")
def _(spark, sf):
    obs = td.index_observations(spark, sf)
    day, before = F.lit("2024-01-15").cast("date"), F.lit("2024-01-14").cast("date")
    run = calc.daily_index(obs.filter(F.col("observation_date") == day), obs.filter(F.col("observation_date") == before), day, before,
                           ix.demo_weights(spark), allow_partial=True)
    return run.national.select("observation_date", "booking_window", "national_index", "status")


@query("a7_overall_status", f"""SELECT {D('observation_date')}, CASE WHEN bool_and(status IN ('SUCCESS', 'PARTIAL_COVERAGE')) THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status FROM natw GROUP BY observation_date""")
def _(spark, sf):
    return fr.history(spark, sf, wide=True).overall_status(True).drop("warnings")


# Every quote is kept; the days after each ninth of the month move on by one, which leaves gaps in the calendar.
cte("gap_obs", "SELECT * REPLACE (observation_date + CAST(day(observation_date) // 9 AS INT) AS observation_date) FROM priced")
cte("gap_pairs", """SELECT c.observation_date, c.route, c.booking_window, exp(avg(ln(c.fare / p.fare))) * 100 AS index_value FROM
(SELECT observation_date, route, booking_window, fingerprint, min(comparable_fare) AS fare FROM gap_obs GROUP BY ALL) c JOIN
(SELECT observation_date, fingerprint, min(comparable_fare) AS fare FROM gap_obs GROUP BY ALL) p ON p.observation_date = c.observation_date - 1 AND p.fingerprint = c.fingerprint GROUP BY ALL""")


def _gapped(spark, sf):
    shift = F.floor(F.dayofmonth("observation_date") / 9).cast("int")
    return td.index_observations(spark, sf).withColumn("observation_date", F.date_add("observation_date", shift))


@query("a8_history_with_gaps", f"""SELECT {D('g.observation_date', 'observation_date')}, g.route, g.booking_window, {R('g.index_value', 'index_value')}, {R('y.index_value', 'previous_index')}
FROM gap_pairs g LEFT JOIN gap_pairs y ON y.observation_date = g.observation_date - 1 AND y.route = g.route AND y.booking_window = g.booking_window""")
def _(spark, sf):
    run = calc.historical_index(_gapped(spark, sf), ix.demo_weights(spark), allow_partial=True)
    return run.grid.filter("index_value is not null").select(*SL3, "index_value", "previous_index")


@query("a8_calendar_gaps", f"""SELECT {D('observation_date')}, {D('previous_date')}, 'Missing historical dates between ' || CAST(previous_date AS VARCHAR) || ' and ' || CAST(observation_date AS VARCHAR) || '; no cross-gap calculation created.' AS warning
FROM (SELECT observation_date, lag(observation_date) OVER (ORDER BY observation_date) AS previous_date FROM (SELECT DISTINCT observation_date FROM gap_obs)) WHERE observation_date - previous_date > 1""")
def _(spark, sf):
    return calc.calendar_gaps(_gapped(spark, sf))


cte("base_day", "SELECT min(observation_date) AS b FROM obs")
cte("fixed_grid0", """
SELECT k.observation_date, k.route, w.booking_window, e.index_value, CASE WHEN e.index_value IS NOT NULL THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status
FROM (SELECT DISTINCT d.observation_date, s.route FROM (SELECT DISTINCT observation_date FROM obs, base_day WHERE observation_date > b) d
  JOIN sizes s ON s.observation_date = d.observation_date OR s.observation_date = (SELECT b FROM base_day)) k CROSS JOIN windows w
LEFT JOIN (SELECT c.observation_date, c.route, c.booking_window, exp(avg(ln(c.fare / p.fare))) * 100 AS index_value FROM best c JOIN best p ON p.fingerprint = c.fingerprint
  WHERE p.observation_date = (SELECT b FROM base_day) AND c.observation_date > (SELECT b FROM base_day) GROUP BY ALL) e USING (observation_date, route, booking_window)
""")
cte("fixed_grid", """
SELECT g.*, coalesce(last_value(index_value IGNORE NULLS) OVER (PARTITION BY route, booking_window ORDER BY observation_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  CASE WHEN route IN (SELECT route FROM demo) THEN 100.0 END) AS previous_index FROM fixed_grid0 g
""")
national("fixed", "fixed_grid", "demo", True)


@query("a9_fixed_base_index", f"SELECT {D('observation_date')}, booking_window, {R('national_index')}, {R('coverage_ratio')}, status FROM fixed")
def _(spark, sf):
    run = calc.fixed_base_index(td.index_observations(spark, sf), ix.demo_weights(spark))
    return run.national.drop("warnings", "weight_version")


@query("a9_fixed_base_contributions", f"SELECT {CONTRIB} FROM fixed_contrib")
def _(spark, sf):
    return calc.fixed_base_index(td.index_observations(spark, sf), ix.demo_weights(spark)).contributions.drop("previous_index")


# ------------------------------------------------------------------- quality


@query("a12_status_counts", """SELECT s.quality_status, CAST(coalesce(n, 0) AS BIGINT) AS observations FROM (VALUES ('VALID'), ('SUSPECT'), ('EXCLUDED'), ('OUTLIER')) s(quality_status)
LEFT JOIN (SELECT quality_status, count(*) AS n FROM cleaned GROUP BY 1) USING (quality_status)""")
def _(spark, sf):
    return q.status_counts(fr.cleaned(spark, sf).observations)


cte("qmetrics", """
SELECT coalesce(k.d, l.d) AS metric_date, coalesce(k.s, l.s) AS source, coalesce(k.n, 0) + coalesce(l.n, 0) AS observation_count, coalesce(k.hits, 0) / 6.0 AS route_coverage,
  CASE WHEN coalesce(k.n, 0) > 0 THEN 1.0 ELSE 0.0 END AS source_coverage,
  CAST(floor(epoch(CAST(coalesce(k.d, l.d) + 1 AS TIMESTAMP) - k.latest) / 60) AS INT) AS freshness_minutes, coalesce(l.n, 0) AS missing_observations, coalesce(k.excluded, 0) AS invalid_observations,
  coalesce(k.outliers, 0) AS anomalous_valid_observations, CAST(coalesce(k.d, l.d) + 1 AS TIMESTAMP) AS generated_at
FROM (SELECT day AS d, canonical AS s, count(*) AS n, count(DISTINCT route) FILTER (route IN (SELECT route FROM demo)) AS hits, max(observation_timestamp) AS latest,
    count(*) FILTER (quality_status = 'EXCLUDED') AS excluded, count(*) FILTER (quality_status = 'OUTLIER') AS outliers FROM cleaned GROUP BY 1, 2) k
FULL JOIN (SELECT day AS d, canonical AS s, count(*) AS n FROM assessed WHERE coalesce(raw_reason, normalize_error, excluded_reason) IS NOT NULL AND canonical IS NOT NULL GROUP BY 1, 2) l
  ON k.d = l.d AND k.s = l.s
""")


def quality_metrics(spark, sf):
    return q.daily_assessed(fr.assessed(spark, sf), ix.demo_weights(spark).select("route"))


@query("d14_daily_quality_metrics", f"""SELECT {D('metric_date')}, source, CAST(observation_count AS BIGINT) AS observation_count, {R('round(route_coverage, 4)', 'route_coverage')}, {R('source_coverage')}, freshness_minutes,
  CAST(missing_observations AS BIGINT) AS missing_observations, CAST(invalid_observations AS BIGINT) AS invalid_observations, CAST(anomalous_valid_observations AS BIGINT) AS anomalous_valid_observations FROM qmetrics""")
def _(spark, sf):
    return quality_metrics(spark, sf).select("metric_date", "source", "observation_count", "route_coverage", "source_coverage", "freshness_minutes",
                                             "missing_observations", "invalid_observations", "anomalous_valid_observations")


@query("a13_quality_summary", f"""SELECT count(*) AS total_observations, count(*) FILTER (quality_status = 'VALID') AS valid_observations, count(*) FILTER (quality_status = 'OUTLIER') AS outlier_count,
  {R("(SELECT round(arg_max(route_coverage, (generated_at, source)), 4) FROM qmetrics)", 'route_coverage')}, (SELECT arg_max(source, (generated_at, source)) FROM qmetrics) AS source,
  (SELECT arg_max(freshness_minutes, (generated_at, source)) FROM qmetrics) AS freshness_minutes, 'OPTIMAL' AS status FROM cleaned WHERE quality_status <> 'EXCLUDED'""")
def _(spark, sf):
    return q.summarize_assessed(fr.assessed(spark, sf), ix.demo_weights(spark).select("route")).select(
        "total_observations", "valid_observations", "outlier_count", "route_coverage", "source", "freshness_minutes", "status"
    )


@query("a14_source_volume", f"SELECT {SL}, count(DISTINCT source) AS source_count, count(*) AS observation_count FROM obs GROUP BY observation_date, route, booking_window")
def _(spark, sf):
    return q.source_volume(td.index_observations(spark, sf), SL3)


def _expected_routes(spark):
    return fr.wide_weights(spark).select("route")


@query("d7_route_coverage", f"SELECT {D('observation_date')}, count(DISTINCT route) FILTER (route IN (SELECT route FROM wide)) AS observed, CAST(6 AS BIGINT) AS expected, {R('count(DISTINCT route) FILTER (route IN (SELECT route FROM wide)) / 6.0', 'route_coverage')} FROM obs GROUP BY observation_date")
def _(spark, sf):
    return q.coverage(td.index_observations(spark, sf), _expected_routes(spark), "route", ["observation_date"])


@query("d8_source_coverage", f"SELECT {D('observation_date')}, count(DISTINCT source) FILTER (source IN ('MAKEMYTRIP', 'YATRA', 'SPICEJET')) AS observed, CAST(3 AS BIGINT) AS expected, {R("count(DISTINCT source) FILTER (source IN ('MAKEMYTRIP', 'YATRA', 'SPICEJET')) / 3.0", 'source_coverage')} FROM obs GROUP BY observation_date")
def _(spark, sf):
    obs = td.index_observations(spark, sf)
    return q.coverage(obs, q.expected_values(obs, "source", ["MAKEMYTRIP", "YATRA", "SPICEJET"]), "source", ["observation_date"])


@query("d9_window_coverage", f"SELECT {D('observation_date')}, route, count(DISTINCT booking_window) AS observed, CAST(5 AS BIGINT) AS expected, {R('count(DISTINCT booking_window) / 5.0', 'booking_window_coverage')} FROM obs GROUP BY observation_date, route")
def _(spark, sf):
    return q.window_coverage(td.index_observations(spark, sf), ["observation_date", "route"])


@query("d10_validity_rate", f"SELECT {D('day', 'observation_date')}, {R('avg(CAST(quality_status = ' + chr(39) + 'VALID' + chr(39) + ' AS INT))', 'validity_rate')} FROM cleaned GROUP BY day")
def _(spark, sf):
    return q.validity_rate(fr.cleaned(spark, sf).observations, ["observation_date"])


NOW_SQL, NOW = "TIMESTAMP '2024-02-01 00:00:00'", "2024-02-01 00:00:00"


@query("d11_freshness_minutes", f"SELECT ingest_seq, {R(f'(epoch_us({NOW_SQL}) - epoch_us(observation_timestamp)) / 6e7', 'freshness')} FROM raw")
def _(spark, sf):
    return td.raw_quotes(spark, sf).select("ingest_seq", q.freshness_minutes(F.col("observation_timestamp"), F.lit(NOW).cast("timestamp")).alias("freshness"))


@query("d12_average_freshness", f"SELECT route, {R(f'avg((epoch_us({NOW_SQL}) - epoch_us(observation_timestamp)) / 6e7)', 'average_freshness_minutes')} FROM obs GROUP BY route")
def _(spark, sf):
    return q.average_freshness(td.index_observations(spark, sf), F.lit(NOW).cast("timestamp"), ["route"])


SORTED = "list_sort(list(comparable_fare))"
MEDIAN = f"({SORTED}[(count(*) + 1) // 2] + ({SORTED}[count(*) // 2 + 1] - {SORTED}[(count(*) + 1) // 2]) * 0.5::DOUBLE)"


@query("d15_missing_fare_estimate", f"""SELECT {SL}, count(*) AS comparable_observations, {R(f'CASE WHEN count(*) >= 3 THEN {cents(MEDIAN)} END', 'estimated_fare')},
  CASE WHEN count(*) < 3 THEN 'INSUFFICIENT_DATA' WHEN count(*) >= 5 THEN 'HIGH' ELSE 'MODERATE' END AS confidence, count(*) >= 3 AS estimated FROM obs GROUP BY observation_date, route, booking_window""")
def _(spark, sf):
    rows = q.missing_fare_estimate(td.index_observations(spark, sf), SL3)
    return rows.select(*SL3, "comparable_observations", "estimated_fare", "confidence", "estimated")


# --------------------------------------------------------- series and features

cte("daily", f"""
SELECT observation_date, route, booking_window, avg(comparable_fare) AS current_fare, count(*) AS observation_count, count(DISTINCT source) AS source_count, max(observation_timestamp) AS latest FROM obs GROUP BY ALL
""")
cte("moving", """
SELECT *, (current_fare - previous_value) / previous_value * 100 AS chg FROM (SELECT *, lag(current_fare) OVER (PARTITION BY route, booking_window ORDER BY observation_date) AS previous_value FROM daily)
""")
cte("moving2", """
SELECT *, chg - lag(chg) OVER s AS accel, avg(current_fare) OVER r AS rmean, quantile_cont(current_fare, 0.5) OVER r AS rmedian, stddev_pop(current_fare) OVER r AS rvol
FROM moving WINDOW s AS (PARTITION BY route, booking_window ORDER BY observation_date), r AS (PARTITION BY route, booking_window ORDER BY observation_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")


def _daily(spark, sf):
    return td.index_observations(spark, sf).groupBy(*SL3).agg(F.avg("comparable_fare").alias("current_fare"))


@query("w1_latest_runs", f"SELECT {D('observation_date')}, booking_window, {R('index_value')}, calculation_version FROM latest")
def _(spark, sf):
    return readside.latest_runs(fr.results(spark, sf)).select("observation_date", "booking_window", "index_value", "calculation_version")


@query("w2_change_to_previous", f"""SELECT {D('observation_date')}, booking_window, {R('(index_value - p) / p * 100', 'change_percent')} FROM (SELECT *, lag(index_value) OVER (PARTITION BY booking_window ORDER BY observation_date) AS p FROM latest)""")
def _(spark, sf):
    return readside.with_previous(readside.latest_runs(fr.results(spark, sf))).select("observation_date", "booking_window", "change_percent")


@query("w3_movement_features", f"SELECT {SL}, {R('previous_value')}, {R('round_even(chg, 4)', 'percentage_change')}, {R('round_even(accel, 4)', 'acceleration')} FROM moving2")
def _(spark, sf):
    return features.movement(_daily(spark, sf), "current_fare").select(*SL3, "previous_value", "percentage_change", "acceleration")


@query("w4_rolling_features", f"SELECT {SL}, {R(cents('rmean'), 'rolling_mean')}, {R(cents('rmedian'), 'rolling_median')}, {R('rvol', 'rolling_volatility')} FROM moving2")
def _(spark, sf):
    # A deviation that ends in half a cent depends on the order of its additions: it is compared before its rounding, within half a cent.
    from pyspark.sql import Window

    w = Window.partitionBy("route", "booking_window").orderBy("observation_date").rowsBetween(-6, 0)
    rows = features.rolling(_daily(spark, sf), "current_fare").withColumn("_v", F.stddev_pop("current_fare").over(w))
    near = F.when(F.abs(F.col("rolling_volatility") - F.col("_v")) < 0.0051, F.col("_v"))
    return rows.select(*SL3, "rolling_mean", "rolling_median", near.alias("rolling_volatility"))


@query("w5_freshness_hours", f"SELECT {SL}, {R('round(greatest(epoch_us(CAST(observation_date + 1 AS TIMESTAMP)) - epoch_us(latest), 0) / 3.6e9, 2)', 'freshness_hours')} FROM daily")
def _(spark, sf):
    latest = td.index_observations(spark, sf).groupBy(*SL3).agg(F.max("observation_timestamp").alias("latest"))
    return latest.select(*SL3, features.freshness_hours(F.col("latest"), F.date_add("observation_date", 1).cast("timestamp")).alias("freshness_hours"))


@query("w6_feature_vectors", f"""SELECT {D('m.observation_date', 'observation_date')}, m.route, m.booking_window, {R('current_fare')}, {R('round_even(chg, 4)', 'percentage_change')}, {R('round_even(accel, 4)', 'acceleration')}, observation_count, source_count,
  {R('c.agreement_ratio', 'cross_source_agreement')}, {R('n.coverage_ratio', 'coverage_ratio')}, {R('rmean', 'rolling_mean')}, {R('rmedian', 'rolling_median')}, {R('rvol', 'rolling_volatility')},
  {R('round(greatest(epoch_us(CAST(m.observation_date + 1 AS TIMESTAMP)) - epoch_us(latest), 0) / 3.6e9, 2)', 'freshness_hours')}
FROM moving2 m LEFT JOIN confirmed c ON c.observation_date = m.observation_date AND c.route = m.route AND c.booking_window = m.booking_window
LEFT JOIN nat n ON n.observation_date = m.observation_date AND n.booking_window = m.booking_window""")
def _(spark, sf):
    rows = features.feature_vectors(td.index_observations(spark, sf), fr.confirmations(spark, sf), fr.history(spark, sf).national)
    # The mean fare behind the rolling columns is added in another order here, so they are compared before their rounding, within half a cent.
    from pyspark.sql import Window

    w = Window.partitionBy("route", "booking_window").orderBy("observation_date").rowsBetween(-6, 0)
    v = F.col("current_fare")
    exact = {"rolling_mean": F.avg(v), "rolling_median": F.percentile(v, F.lit(0.5)), "rolling_volatility": F.stddev_pop(v)}
    rows = rows.withColumns({f"_{n}": e.over(w) for n, e in exact.items()})
    near = [F.when(F.abs(F.col(n) - F.col(f"_{n}")) < 0.0051, F.col(f"_{n}")).alias(n) for n in exact]
    return rows.select(*SL3, "current_fare", "percentage_change", "acceleration", "observation_count", "source_count", "cross_source_agreement", "coverage_ratio",
                       *near, "freshness_hours")


cte("patterned", """
SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN lo >= 1 THEN 'UPWARD' WHEN hi <= -1 THEN 'DOWNWARD' ELSE 'STABLE' END AS pattern FROM (
  SELECT *, count(d) OVER r AS n, min(d) OVER r AS lo, max(d) OVER r AS hi, avg(d) OVER r AS av FROM (
    SELECT observation_date, route, booking_window, index_value, index_value - lag(index_value) OVER (PARTITION BY route, booking_window ORDER BY observation_date) AS d FROM grid WHERE index_value IS NOT NULL)
  WINDOW r AS (PARTITION BY route, booking_window ORDER BY observation_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
""")


@query("w7_persistent_pattern", f"""SELECT {SL}, pattern, pattern IN ('UPWARD', 'DOWNWARD') AS detected, {R('CASE WHEN n >= 3 THEN av END', 'average_change')},
  CASE pattern WHEN 'INSUFFICIENT_DATA' THEN 'Insufficient historical index values for pattern detection.' WHEN 'STABLE' THEN 'No persistent directional pattern detected in the recent movements.'
    ELSE 'Persistent ' || lower(pattern) || ' pattern detected across 3 consecutive movements.' END AS reason FROM patterned""")
def _(spark, sf):
    return features.persistent_pattern(fr.history(spark, sf).grid).select(*SL3, "pattern", "detected", "average_change", "reason")


@query("w7_latest_pattern", f"SELECT {SL}, pattern FROM patterned QUALIFY row_number() OVER (PARTITION BY route, booking_window ORDER BY observation_date DESC) = 1")
def _(spark, sf):
    return features.latest_pattern(fr.history(spark, sf).grid).select(*SL3, "pattern")


# --------------------------------------------------------------- set and JSON


@query("u1_routes_of_both_days", f"SELECT {D('observation_date')}, route FROM seen")
def _(spark, sf):
    products = pairing.consecutive_products(td.index_observations(spark, sf))
    return ix.calendar_transitions(ix.elementary_slices(products)).select("observation_date", "route").distinct()


@query("u4_result_json", """SELECT observation_date::VARCHAR AS observation_date, booking_window, '{"booking_window":"' || booking_window || '","national_index":"' || printf('%.4f', national_index) || '","status":"' || status || '"}' AS body FROM nat WHERE national_index IS NOT NULL""")
def _(spark, sf):
    rows = fr.history(spark, sf).national.filter(finite(F.col("national_index")).isNotNull())
    body = F.to_json(F.struct("booking_window", F.format_string("%.4f", "national_index").alias("national_index"), "status"))
    return rows.select("observation_date", "booking_window", body.alias("body"))
