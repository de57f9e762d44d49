"""Registered queries: signals, evaluation, validation and monthly comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import evaluation as ev, monthly, signals, validation as va
from ..plans import intelligence, validation_report as vr
from ..sources import cpi, testdata as td
from . import frames as fr
from .index_queries import SL, SL3, shock_inputs
from .registry import D, L, R, cents, cte, query

# ------------------------------------------------------------------- signals


@query("x1_detect_anomalies", f"SELECT {SL}, {R('point_change')}, {R('percentage_change')}, {R('anomaly_score')}, severity, severity <> 'NORMAL' AS detected FROM anomaly")
def _(spark, sf):
    rows = signals.detect_anomalies(fr.history(spark, sf).grid.filter("index_value is not null"))
    return rows.select(*SL3, "point_change", "percentage_change", "anomaly_score", "severity", "detected")


@query("x2_explanations", f"SELECT {SL}, reason FROM explained")
def _(spark, sf):
    return fr.anomalies(spark, sf).select(*SL3, "reason")


@query("x3_source_means", f"SELECT {SL}, source, {R('average_fare')}, quotes FROM smeans")
def _(spark, sf):
    return signals.source_means(td.index_observations(spark, sf)).drop("fare_sum")


@query("x4_confirm_sources", f"""SELECT {SL}, {L('sources')}, CAST(n AS INT) AS source_count, {L('agreeing_sources')}, {R('agreement_ratio')}, direction, confirmed,
  CASE WHEN n < 2 THEN 'INSUFFICIENT' WHEN NOT confirmed THEN 'WEAK' WHEN agreement_ratio >= 0.75 THEN 'STRONG' ELSE 'MODERATE' END AS strength,
  CASE WHEN n < 2 THEN 'Insufficient independent sources for cross-source confirmation.' WHEN NOT confirmed THEN 'Sources do not provide sufficient directional agreement for confirmation.'
    ELSE agree || ' of ' || n || ' sources support a ' || lower(direction) || ' movement.' END AS reason,
  CASE WHEN n < 2 THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS status FROM confirmed""")
def _(spark, sf):
    return fr.confirmations(spark, sf)


cte("freshness", "SELECT observation_date, round(epoch_us(CAST(observation_date + 1 AS TIMESTAMP) - max(observation_timestamp)) / 3.6e9, 2) AS freshness_hours FROM obs GROUP BY 1")
cte("shock0", """
SELECT n.observation_date, n.booking_window, n.coverage_ratio, f.freshness_hours, count(m.route) AS k, avg(m.pct) AS avg_move, max(m.apct) AS max_move, arg_max(m.route, m.apct) AS max_route,
  coalesce(list(m.route ORDER BY m.route) FILTER (m.apct >= 5), []) AS affected, coalesce(list(m.route ORDER BY m.route) FILTER (abs(m.acceleration) >= 2), []) AS accel,
  coalesce(list(m.route ORDER BY m.route) FILTER (m.apct >= 5 AND c.confirmed), []) AS conf, coalesce(list(m.route ORDER BY m.route) FILTER (abs(m.deviation) >= 5), []) AS hist,
  count(*) FILTER (m.quality_status NOT IN ('EXCLUDED', 'OUTLIER')) AS usable
FROM nat n JOIN freshness f USING (observation_date) LEFT JOIN moves m ON m.observation_date = n.observation_date AND m.booking_window = n.booking_window
LEFT JOIN confirmed c ON c.observation_date = m.observation_date AND c.booking_window = m.booking_window AND c.route = m.route GROUP BY ALL
""")
cte("shock1", """
SELECT *, len(affected) >= 2 AND len(affected) / k >= 0.5 AS many, k > 0 AND max_move >= 5 AND len(affected) >= 2 AND len(affected) / k >= 0.5 AND len(conf) > 0
  AND coverage_ratio >= 0.5 AND freshness_hours <= 48 AND usable > 0 AS potential FROM shock0
""")
cte("shock", """
SELECT *, coalesce(potential, FALSE) AS detected, CASE WHEN k > 0 AND max_move >= 20 THEN 'HIGH' WHEN k > 0 AND max_move >= 10 THEN 'MEDIUM' WHEN k > 0 AND max_move >= 5 THEN 'LOW' ELSE 'NONE' END AS severity,
  CASE WHEN coalesce(potential, FALSE) THEN 'POTENTIAL_AIRFARE_SHOCK' WHEN len(conf) > 0 THEN 'CROSS_SOURCE_CONFIRMATION' WHEN many THEN 'MULTIPLE_ROUTES' WHEN len(accel) > 0 THEN 'ACCELERATION' ELSE 'NORMAL' END AS stage
FROM shock1
""")


def _shocks(spark, sf):
    made = fr.prepared(spark, sf)
    groups = made.run.national.join(fr.freshness(made.facts), "observation_date")
    confirmations = signals.confirm_sources(signals.source_movements(signals.facts_means(made.facts)))
    return signals.detect_shocks(shock_inputs(spark, sf, made), groups, confirmations)


@query("x5_detect_shocks", f"""SELECT {D('observation_date')}, booking_window, detected, severity, stage, {R('avg_move', 'average_movement')}, {R('max_move', 'maximum_movement')}, max_route AS maximum_movement_route,
  {L('affected', 'affected_routes')}, CAST(k AS BIGINT) AS comparable_route_count, {L('accel', 'acceleration_routes')}, {L('conf', 'cross_source_confirmed_routes')}, {L('hist', 'historical_support_routes')},
  {R('coalesce(usable / nullif(k, 0), 0)', 'quality_ratio')} FROM shock""")
def _(spark, sf):
    return _shocks(spark, sf).select(
        "observation_date", "booking_window", "detected", "severity", "stage", "average_movement", "maximum_movement", "maximum_movement_route",
        "affected_routes", "comparable_route_count", "acceleration_routes", "cross_source_confirmed_routes", "historical_support_routes", "quality_ratio",
    )


@query("x5b_shock_reasons", f"""SELECT {D('observation_date')}, booking_window, CASE WHEN k = 0 THEN 'Insufficient comparable route-level data for shock detection.' ELSE
  concat_ws(' ', 'Overall movement was ' || CASE WHEN avg_move > 0 THEN 'upward' WHEN avg_move < 0 THEN 'downward' ELSE 'stable' END || '.', 'Maximum route movement was ' || printf('%.2f', max_move) || '%.',
  len(affected) || ' of ' || k || ' comparable routes met the movement threshold.', CASE WHEN len(accel) > 0 THEN 'Acceleration was observed on ' || len(accel) || ' route(s).' END,
  CASE WHEN len(conf) > 0 THEN 'Cross-source confirmation was available for ' || len(conf) || ' affected route(s).' END,
  CASE WHEN len(hist) > 0 THEN len(hist) || ' route(s) also deviated materially from the supplied historical baseline.' END, 'Coverage ratio was ' || printf('%.2f', coverage_ratio) || '.',
  'Observation freshness was ' || printf('%.2f', freshness_hours) || ' hour(s).', 'Usable data-quality ratio was ' || printf('%.2f', usable / k) || '.', 'Evidence stage: ' || stage || '.',
  CASE WHEN NOT detected THEN 'The evidence is treated as a supporting intelligence signal rather than an official airfare-shock classification.' END) END AS reason FROM shock""")
def _(spark, sf):
    return _shocks(spark, sf).select("observation_date", "booking_window", "reason")


cte("scored", """
SELECT a.observation_date, a.route, a.booking_window, a.percentage_change, a.anomaly_score, c.agreement_ratio, n.coverage_ratio, f.freshness_hours, s.source_count / 5.0 AS source_coverage, s.k AS observation_count
FROM explained a LEFT JOIN confirmed c ON c.observation_date = a.observation_date AND c.route = a.route AND c.booking_window = a.booking_window
LEFT JOIN nat n ON n.observation_date = a.observation_date AND n.booking_window = a.booking_window LEFT JOIN freshness f ON f.observation_date = a.observation_date
LEFT JOIN (SELECT observation_date, route, booking_window, count(DISTINCT source) AS source_count, count(*) AS k FROM obs GROUP BY ALL) s
  ON s.observation_date = a.observation_date AND s.route = a.route AND s.booking_window = a.booking_window
""")


def _score_inputs(spark, sf):
    made = fr.prepared(spark, sf)
    confirmations = signals.confirm_sources(signals.source_movements(signals.facts_means(made.facts)))
    return (
        signals.detect_anomalies(made.run.grid.filter("index_value is not null")).select(*SL3, "percentage_change", "anomaly_score")
        .join(confirmations.select(*SL3, "agreement_ratio"), list(SL3), "left")
        .join(made.run.national.select("observation_date", "booking_window", "coverage_ratio"), ["observation_date", "booking_window"], "left")
        .join(fr.freshness(made.facts), "observation_date", "left")
        .join(signals.facts_slices(made.facts).drop("baseline"), list(SL3), "left")
        .withColumn("source_coverage", F.col("source_count") / 5.0)
        .withColumn("anomaly_available", F.col("percentage_change").isNotNull())
        .withColumn("expected_observation_count", F.lit(20))
    )


PRESSURE = """CASE WHEN percentage_change IS NOT NULL THEN (0.35 * least(100, abs(percentage_change) * 5) + 0.15 * least(100, anomaly_score) + coalesce(0.15 * agreement_ratio * 100, 0) + coalesce(0.05 * source_coverage * 100, 0))
  / (0.5 + CASE WHEN agreement_ratio IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN source_coverage IS NOT NULL THEN 0.05 ELSE 0 END) END"""
CONFIDENCE = """(0.25 * coverage_ratio * 100 + coalesce(0.10 * source_coverage * 100, 0) + coalesce(0.15 * least(1, observation_count / 20.0) * 100, 0) + coalesce(0.20 * agreement_ratio * 100, 0)
  + 0.10 * greatest(0, (1 - freshness_hours / 48) * 100) + 0.05 * CASE WHEN percentage_change IS NOT NULL THEN 100 ELSE 0 END)
  / (0.40 + CASE WHEN source_coverage IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN observation_count IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN agreement_ratio IS NOT NULL THEN 0.20 ELSE 0 END)"""


def level(score: str) -> str:
    return f"CASE WHEN ({score}) IS NULL THEN 'INSUFFICIENT_DATA' WHEN ({score}) < 25 THEN 'LOW' WHEN ({score}) < 50 THEN 'MODERATE' WHEN ({score}) < 75 THEN 'HIGH' ELSE 'VERY_HIGH' END"


@query("x6_pressure_score", f"""SELECT {SL}, {R('round_even(' + PRESSURE + ', 2)', 'pressure_score')}, {level('round_even(' + PRESSURE + ', 2)')} AS pressure_level, CASE WHEN percentage_change IS NULL THEN 'Insufficient fare movement data.' ELSE concat_ws(' ',
  'because the fare ' || CASE WHEN percentage_change > 0 THEN 'increased' WHEN percentage_change < 0 THEN 'decreased' ELSE 'remained stable' END || ' by ' || printf('%.2f', abs(percentage_change)) || '%.',
  'Anomaly signal was ' || printf('%.1f', least(100, abs(anomaly_score))) || '/100.', 'Cross-source agreement was ' || printf('%.1f', agreement_ratio * 100) || '%.', 'Source coverage was ' || printf('%.1f', source_coverage * 100) || '%.') END AS reason FROM scored""")
def _(spark, sf):
    # The score in the text is the column beside it; its number is written with as many places as it has.
    reason = F.regexp_replace("pressure_reason", "^Fare pressure score is [0-9.]+/100 ", "")
    return signals.pressure_score(_score_inputs(spark, sf)).select(*SL3, "pressure_score", "pressure_level", reason.alias("reason"))


@query("x7_confidence_score", f"SELECT {SL}, {R('round_even(' + CONFIDENCE + ', 2)', 'confidence_score')}, {level('round_even(' + CONFIDENCE + ', 2)')} AS confidence_level FROM scored")
def _(spark, sf):
    return signals.confidence_score(_score_inputs(spark, sf)).select(*SL3, "confidence_score", "confidence_level")


def _analysis(spark, sf):
    made = fr.prepared(spark, sf)
    return intelligence.analyze(made.run.grid, made.run.national, td.index_observations(spark, sf), facts=made.facts)


P8 = """CASE WHEN percentage_change IS NOT NULL THEN (0.35 * least(100, abs(percentage_change) * 5) + 0.15 * least(100, anomaly_score) + coalesce(0.15 * agreement_ratio * 100, 0))
  / (0.5 + CASE WHEN agreement_ratio IS NOT NULL THEN 0.15 ELSE 0 END) END"""
C8 = """(0.25 * coverage_ratio * 100 + coalesce(0.20 * agreement_ratio * 100, 0) + 0.05 * CASE WHEN percentage_change IS NOT NULL THEN 100 ELSE 0 END)
  / (0.30 + CASE WHEN agreement_ratio IS NOT NULL THEN 0.20 ELSE 0 END)"""


@query("x8_combined_analysis", f"SELECT {SL}, {R('percentage_change')}, {R('agreement_ratio')}, {R('round_even(' + P8 + ', 2)', 'pressure_score')}, {R('round_even(' + C8 + ', 2)', 'confidence_score')} FROM scored")
def _(spark, sf):
    return _analysis(spark, sf).scores.select(*SL3, "percentage_change", "agreement_ratio", "pressure_score", "confidence_score")


@query("x9_index_warnings", f"""SELECT {D('observation_date')}, booking_window, route, '[' || booking_window || '] Index value unavailable for route ' || route || '.' AS warning FROM grid WHERE index_value IS NULL
UNION ALL SELECT {D('observation_date')}, booking_window, NULL, 'Statistical Engine status: INSUFFICIENT_DATA.' FROM nats WHERE observation_date IN (SELECT observation_date FROM nats WHERE status <> 'SUCCESS')""")
def _(spark, sf):
    run = fr.history(spark, sf, partial=False, wide=True)
    return intelligence.index_warnings(run.grid, run.national)


NO_INDEX, NO_NATIONAL = "day(observation_date) % 7 = 0 AND booking_window = 'T+30'", "day(observation_date) % 5 = 0 AND booking_window <> 'T+7'"


@query("x9_absent_results", f"""SELECT {D('observation_date')}, booking_window, route, '[' || booking_window || '] Index value unavailable for route ' || route || '.' AS warning FROM grid WHERE index_value IS NULL AND NOT ({NO_INDEX})
UNION ALL SELECT {D('observation_date')}, booking_window, route, '[' || booking_window || '] No index result available for route ' || route || '.' FROM grid WHERE {NO_INDEX}
UNION ALL SELECT {D('observation_date')}, booking_window, NULL, '[' || booking_window || '] National result unavailable; coverage is unknown.' FROM nats WHERE {NO_NATIONAL}
UNION ALL SELECT {D('observation_date')}, booking_window, NULL, 'Statistical Engine status: INSUFFICIENT_DATA.' FROM nats
  WHERE NOT ({NO_NATIONAL}) AND observation_date IN (SELECT observation_date FROM nats WHERE status <> 'SUCCESS' AND NOT ({NO_NATIONAL}))""")
def _(spark, sf):
    run = fr.history(spark, sf, partial=False, wide=True)
    return intelligence.index_warnings(run.grid.filter(f"NOT ({NO_INDEX})"), run.national.filter(f"NOT ({NO_NATIONAL})"))


cte("events_out", """
SELECT *, CASE WHEN anomaly_score >= 4 THEN 'AIRFARE_SHOCK' ELSE 'ANOMALY' END AS event_type, least(100, greatest(0, anomaly_score * 10 + 35)) AS pressure_score FROM explained WHERE detected OR anomaly_score >= 3
""")


@query("e1_event_rows", f"""SELECT {SL}, event_type, {R('round_even(anomaly_score, 4)', 'anomaly_score')}, {R('round_even(pressure_score, 4)', 'pressure_score')}, CASE WHEN event_type = 'AIRFARE_SHOCK' THEN 'ALERT' ELSE 'NORMAL' END AS shock_status, reason AS explanation, route AS affected_routes FROM events_out""")
def _(spark, sf):
    return signals.event_rows(fr.anomalies(spark, sf)).select(
        *SL3, "event_type", "anomaly_score", "pressure_score", "shock_status", "explanation", "affected_routes"
    )


# ---------------------------------------------------------------- evaluation

# Labels of the evaluation: a move of more than 40 % is an event, the detector flags more than 30 % (second run 35 %).
cte("steps", """
SELECT route, booking_window, row_number() OVER (PARTITION BY route, booking_window ORDER BY observation_date) AS step, anomaly_score > 40 AS actual, anomaly_score > 30 AS predicted, anomaly_score > 35 AS predicted2
FROM anomaly WHERE anomaly_score IS NOT NULL
""")


def _steps(spark, sf, flag=30):
    from pyspark.sql import Window

    w = Window.partitionBy("route", "booking_window").orderBy("observation_date")
    rows = fr.anomalies(spark, sf).filter("anomaly_score is not null")
    return rows.select("route", "booking_window", F.row_number().over(w).alias("step"), (F.col("anomaly_score") > 40).alias("actual"),
                       (F.col("anomaly_score") > flag).alias("predicted"))


CONFUSION = """count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND NOT predicted) AS tn, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn"""


@query("a15_classification", f"""SELECT booking_window, tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, {R('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {R('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {R('coalesce(fp / nullif(fp + tn, 0), 0)', 'false_positive_rate')}, {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1_score')} FROM (SELECT booking_window, {CONFUSION} FROM steps GROUP BY 1)""")
def _(spark, sf):
    return ev.classification(_steps(spark, sf), by=["booking_window"])


@query("a16_prediction_stability", f"SELECT booking_window, {R('avg(CAST(predicted = predicted2 AS INT))', 'stability')} FROM steps GROUP BY 1")
def _(spark, sf):
    return ev.prediction_stability(_steps(spark, sf), _steps(spark, sf, 35), ["route", "booking_window", "step"], by=["booking_window"])


DELAY = """SELECT s.route, s.booking_window, CAST(min(step) FILTER (predicted AND step >= e.event_step) - min(e.event_step) AS INT) AS detection_delay
FROM steps s LEFT JOIN (SELECT route, booking_window, min(step) FILTER (actual) AS event_step FROM steps GROUP BY 1, 2) e ON e.route = s.route AND e.booking_window = s.booking_window GROUP BY 1, 2"""


@query("w10_detection_delay", DELAY)
def _(spark, sf):
    return ev.detection_delay(_steps(spark, sf), by=["route", "booking_window"])


@query("a17_evaluate_detector", f"""SELECT d.route, d.booking_window, d.detection_delay, c.n AS sample_count, {R('c.stability', 'stability')}, c.tp AS true_positive, c.fp AS false_positive, 'anomaly' AS detector
FROM ({DELAY}) d JOIN (SELECT route, booking_window, count(*) AS n, avg(CAST(predicted = predicted2 AS INT)) AS stability, {CONFUSION} FROM steps GROUP BY 1, 2) c ON c.route = d.route AND c.booking_window = d.booking_window""")
def _(spark, sf):
    key = ["route", "booking_window"]
    rows = ev.evaluate_detector(_steps(spark, sf), "anomaly", [*key, "step"], _steps(spark, sf, 35), by=key)
    return rows.select(*key, "detection_delay", "sample_count", "stability", "true_positive", "false_positive", "detector")


# ---------------------------------------------------------------- validation

START, END = "1996-01-01", "1998-12-31"
DAYS = 1096
cte("aligned_all", "SELECT o.booking_window, o.observation_date, o.index_value AS calculated, s.index_value AS reference FROM orderidx o JOIN shipidx s USING (observation_date, booking_window)")
cte("aligned", f"SELECT * FROM aligned_all WHERE observation_date BETWEEN DATE '{START}' AND DATE '{END}'")
cte("span", "SELECT date_diff('day', min(d), max(d)) + 1 AS days FROM (SELECT observation_date AS d FROM orderidx UNION ALL SELECT observation_date FROM shipidx)")
cte("stepped", """SELECT *, calculated - lag(calculated) OVER w AS dc, reference - lag(reference) OVER w AS dr FROM aligned_all WINDOW w AS (PARTITION BY booking_window ORDER BY observation_date)""")
cte("ranked", """SELECT *, rank() OVER (PARTITION BY booking_window ORDER BY calculated) + (count(*) OVER (PARTITION BY booking_window, calculated) - 1) / 2.0 AS rc,
  rank() OVER (PARTITION BY booking_window ORDER BY reference) + (count(*) OVER (PARTITION BY booking_window, reference) - 1) / 2.0 AS rr FROM stepped""")
SIGN = "CASE WHEN {0} > 1e-7 THEN 1 WHEN {0} < -1e-7 THEN -1 WHEN {0} IS NOT NULL THEN 0 END"
SAME = f"({SIGN.format('dc')}) = ({SIGN.format('dr')})"


def _aligned(spark, sf):
    start, end = F.lit(START).cast("date"), F.lit(END).cast("date")
    return va.align_daily(td.order_index(spark, sf), td.ship_index(spark, sf), start, end)


def _span(spark, sf):
    """First and last date of both series, as values that the query itself finds."""
    days = td.order_index(spark, sf).select("observation_date").unionByName(td.ship_index(spark, sf).select("observation_date"))
    ends = days.agg(F.struct(F.min("observation_date").alias("first"), F.max("observation_date").alias("last"))).scalar()
    return ends["first"], ends["last"]


def _days(spark, sf):
    first, last = _span(spark, sf)
    return F.date_diff(last, first) + 1


def _aligned_all(spark, sf):
    return va.align_daily(td.order_index(spark, sf), td.ship_index(spark, sf), *_span(spark, sf))


@query("j6_align_daily", f"SELECT booking_window, {D('observation_date')}, {R('calculated')}, {R('reference')} FROM aligned")
def _(spark, sf):
    return _aligned(spark, sf)


@query("v1_pearson", f"SELECT booking_window, {R('corr(calculated, reference)', 'value')}, 'VALID' AS status, count(*) AS sample_size FROM aligned_all GROUP BY 1")
def _(spark, sf):
    return va.pearson(_aligned_all(spark, sf))


@query("v2_spearman", f"SELECT booking_window, {R('corr(rc, rr)', 'value')}, 'VALID' AS status, count(*) AS sample_size FROM ranked GROUP BY 1")
def _(spark, sf):
    return va.spearman(_aligned_all(spark, sf))


@query("v3_mean_absolute_error", f"SELECT booking_window, {R('avg(abs(calculated - reference))', 'mae')} FROM aligned_all GROUP BY 1")
def _(spark, sf):
    return va.clean_pairs(_aligned_all(spark, sf)).groupBy("booking_window").agg(va.mean_absolute_error().alias("mae"))


@query("v4_root_mean_squared_error", f"SELECT booking_window, {R('sqrt(avg((calculated - reference) * (calculated - reference)))', 'rmse')} FROM aligned_all GROUP BY 1")
def _(spark, sf):
    return va.clean_pairs(_aligned_all(spark, sf)).groupBy("booking_window").agg(va.root_mean_squared_error().alias("rmse"))


@query("v5_temporal_coverage", f"SELECT booking_window, {R(f'count(*) * 1.0 / (SELECT days FROM span)', 'coverage')} FROM aligned_all GROUP BY 1")
def _(spark, sf):
    return _aligned_all(spark, sf).groupBy("booking_window").agg(va.temporal_coverage(F.count(F.lit(1)), _days(spark, sf)).alias("coverage"))


METRICS = {
    "pearson_correlation": ("corr(calculated, reference)", "count(*)", ""),
    "spearman_correlation": ("corr(rc, rr)", "count(*)", ""),
    "mae": ("avg(abs(calculated - reference))", "count(*)", ""),
    "rmse": ("sqrt(avg((calculated - reference) * (calculated - reference)))", "count(*)", ""),
    "directional_accuracy": (f"avg(CAST({SAME} AS INT))", f"count({SAME})", ""),
    "coverage": (f"count(*) * 1.0 / (SELECT days FROM span)", "count(*)", ""),
    "stability": ("stddev_samp(dc)", "count(dc)", "Sample standard deviation of first differences"),
}
METRIC_SQL = " UNION ALL ".join(
    f"SELECT booking_window, '{m}' AS metric, {R(v, 'value')}, 'VALID' AS status, CAST({n} AS BIGINT) AS sample_size, '{note}' AS note FROM ranked GROUP BY booking_window"
    for m, (v, n, note) in METRICS.items()
)


@query("v6_all_metrics", METRIC_SQL)
def _(spark, sf):
    return va.all_metrics(_aligned_all(spark, sf), _days(spark, sf))


@query("v7_backtest", f"""SELECT booking_window, CAST({DAYS} AS INT) AS expected_days, count(*) AS matched_days, CASE WHEN max(count(*)) OVER () >= {DAYS} * 0.5 THEN 'COMPLETED' ELSE 'LOW_DATA' END AS status,
  CASE WHEN count(*) < {DAYS} THEN '[' || booking_window || '] Missing ' || ({DAYS} - count(*)) || ' dates out of {DAYS} expected days.' END AS warning FROM aligned GROUP BY 1""")
def _(spark, sf):
    _, summary = vr.backtest(td.order_index(spark, sf), td.ship_index(spark, sf), F.lit(START).cast("date"), F.lit(END).cast("date"))
    return summary


@query("w8_directional_accuracy", f"SELECT booking_window, {R(f'avg(CAST({SAME} AS INT))', 'value')}, 'VALID' AS status, count({SAME}) AS sample_size FROM stepped GROUP BY 1")
def _(spark, sf):
    return va.directional_accuracy(_aligned_all(spark, sf))


@query("w9_stability", f"SELECT booking_window, {R('stddev_samp(dc)', 'value')}, 'VALID' AS status, count(dc) AS sample_size FROM stepped GROUP BY 1")
def _(spark, sf):
    return va.stability(_aligned_all(spark, sf))


@query("w11_average_ranks", f"SELECT booking_window, {D('observation_date')}, {R('rc', 'fractional_rank')} FROM ranked")
def _(spark, sf):
    rows = va.average_ranks(va.clean_pairs(_aligned_all(spark, sf)), "calculated", "fractional_rank", ["booking_window"])
    return rows.select("booking_window", "observation_date", "fractional_rank")


# ------------------------------------------------------------------- monthly

cte("own_months", f"SELECT strftime(observation_date, '%Y-%m') AS month, round_even(avg(index_value), 4) AS own_index FROM orderidx WHERE booking_window = 'T+15' GROUP BY 1")
cte("ref_months", "SELECT strftime(reference_date, '%Y-%m') AS month, index_value AS reference_index FROM cpi")
cte("all_months", """SELECT coalesce(o.month, r.month) AS month, own_index, reference_index, CASE WHEN own_index IS NOT NULL AND reference_index IS NOT NULL THEN 'ALIGNED' WHEN own_index IS NOT NULL THEN 'PROJECT_ONLY' ELSE 'MOSPI_REFERENCE' END AS status
FROM own_months o FULL JOIN ref_months r ON o.month = r.month""")
cte("last_common", "SELECT * FROM all_months WHERE status = 'ALIGNED' ORDER BY month DESC LIMIT 1")
cte("common", "SELECT *, lag(own_index) OVER (ORDER BY month) AS p_own, lag(reference_index) OVER (ORDER BY month) AS p_ref FROM all_months WHERE status = 'ALIGNED'")


def _reference(spark, sf):
    return cpi.national_series(td.cpi_sheet(spark, sf))


def _months(spark, sf):
    return monthly.align_months(monthly.monthly_mean(fr.long_results(spark, sf)), monthly.monthly_reference(_reference(spark, sf)))


@query("a10_monthly_mean", f"SELECT month, {R('own_index')} FROM own_months")
def _(spark, sf):
    return monthly.monthly_mean(fr.long_results(spark, sf))


@query("j7_align_months", f"SELECT month, {R('own_index')}, {R('reference_index')}, status FROM all_months")
def _(spark, sf):
    return _months(spark, sf)


@query("a11_rebase_months", f"""SELECT a.month, {R('a.own_index', 'own_index')}, {R('a.reference_index', 'reference_index')}, a.status, l.month AS reference_month, {R('round_even(a.own_index / l.own_index * 100, 2)', 'own_rebased')},
  {R('round_even(a.reference_index / l.reference_index * 100, 2)', 'reference_rebased')} FROM all_months a, last_common l""")
def _(spark, sf):
    return monthly.rebase_months(_months(spark, sf))


@query("v8_monthly_correlation", f"SELECT count(*) AS overlapping_months, {R('round_even(CASE WHEN count(*) >= 3 THEN corr(own_index, reference_index) END, 4)', 'correlation')}, CASE WHEN count(*) >= 3 THEN 'CONNECTED' ELSE 'INSUFFICIENT_OVERLAP' END AS correlation_status FROM common")
def _(spark, sf):
    return monthly.month_comparison(_months(spark, sf)).select("overlapping_months", "correlation", "correlation_status")


@query("v9_level_difference", f"""SELECT month AS reference_month, {R('round_even(abs(own_index - reference_index), 4)', 'absolute_difference')}, {R('round_even((own_index - reference_index) / reference_index * 100, 2)', 'percentage_difference')},
  CASE WHEN (SELECT count(*) FROM common) = 1 THEN 'Absolute Level Difference' ELSE 'Mean Absolute Error (MAE)' END AS difference_label FROM last_common""")
def _(spark, sf):
    return monthly.month_comparison(_months(spark, sf)).select("reference_month", "absolute_difference", "percentage_difference", "difference_label")


@query("w12_month_over_month", f"SELECT month AS reference_month, {R('round_even((own_index / p_own - 1) * 100, 2)', 'own_mom')}, {R('round_even((reference_index / p_ref - 1) * 100, 2)', 'reference_mom')} FROM common ORDER BY month DESC LIMIT 1")
def _(spark, sf):
    return monthly.month_comparison(_months(spark, sf)).select("reference_month", "own_mom", "reference_mom")


@query("j12_overlay_months", f"SELECT {D('observation_date')}, {R(cents('index_value'), 'calculated_index')}, {R('round_even(reference_index, 2)', 'reference_index')} FROM orderidx LEFT JOIN ref_months ON month = strftime(observation_date, '%Y-%m') WHERE booking_window = 'T+15'")
def _(spark, sf):
    return monthly.overlay_months(fr.long_results(spark, sf), monthly.monthly_reference(_reference(spark, sf)))


cte("vol", """SELECT booking_window, coalesce(stddev_samp(c), 0) AS volatility FROM (SELECT booking_window, (index_value - lag(index_value) OVER w) / lag(index_value) OVER w * 100 AS c FROM orderidx
WINDOW w AS (PARTITION BY booking_window ORDER BY observation_date)) GROUP BY 1""")


@query("w13_daily_volatility", f"SELECT booking_window, {R('volatility')}, printf('%.2f', volatility) AS volatility_text, CASE WHEN CAST(printf('%.2f', volatility) AS DOUBLE) < 5 THEN 'STABLE' ELSE 'VOLATILE' END AS status FROM vol")
def _(spark, sf):
    return monthly.daily_volatility(fr.long_results(spark, sf))


CORRIDOR = "(SELECT 100.0 * avg(CAST(status = 'SUCCESS' AS INT)) FROM grid WHERE booking_window = 'T+15' AND observation_date = (SELECT max(observation_date) FROM grid WHERE booking_window = 'T+15'))"


LAST_RUN = """(SELECT 100.0 * avg(CAST(status = 'SUCCESS' AS INT)) FROM route_results JOIN (SELECT observation_date, booking_window, calculation_version FROM results
WHERE status = 'SUCCESS' AND booking_window = 'T+15' ORDER BY observation_date DESC, calculation_timestamp DESC LIMIT 1) USING (observation_date, booking_window, calculation_version))"""


@query("v10_corridor_coverage", f"SELECT {R(LAST_RUN, 'coverage_percent')}, CASE WHEN printf('%.1f', {LAST_RUN}) = '100.0' THEN 'OPTIMAL' ELSE 'PARTIAL' END AS status")
def _(spark, sf):
    rows = monthly.corridor_coverage(fr.route_results(spark, sf), results=fr.results(spark, sf))
    return rows.select("coverage_percent", "status")


def _report(spark, sf):
    return vr.validation_report(fr.long_results(spark, sf), fr.history(spark, sf).grid, _reference(spark, sf))


VALUES_SQL = f"""SELECT 'Pearson Correlation (r)' AS metric, (SELECT coalesce(printf('%.4f', CASE WHEN count(*) >= 3 THEN corr(own_index, reference_index) END), 'N/A') FROM common) AS value, 'CONNECTED' AS status
UNION ALL SELECT 'Spearman Rank Correlation (rho)', 'N/A', 'CONNECTED'
UNION ALL SELECT 'Mean Absolute Error (MAE)', printf('%.2f', abs(own_index - reference_index)) || ' pts', 'CONNECTED' FROM last_common
UNION ALL SELECT 'Percentage Difference', printf('%+.2f', (own_index - reference_index) / reference_index * 100) || '%', 'CONNECTED' FROM last_common
UNION ALL SELECT 'Corridor Coverage', printf('%.1f', {CORRIDOR}) || '%', CASE WHEN printf('%.1f', {CORRIDOR}) = '100.0' THEN 'OPTIMAL' ELSE 'PARTIAL' END
UNION ALL SELECT 'Index Stability', printf('%.2f', volatility), CASE WHEN CAST(printf('%.2f', volatility) AS DOUBLE) < 5 THEN 'STABLE' ELSE 'VOLATILE' END FROM vol WHERE booking_window = 'T+15'"""
TEXTS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.METRIC_TEXTS.items())


@query("v11_validation_metrics", f"SELECT metric, value, status, CASE metric {TEXTS_SQL} END AS description FROM ({VALUES_SQL})")
def _(spark, sf):
    return _report(spark, sf).metrics


@query("v11_reference_description", f"SELECT count(*) AS records, {D('min(reference_date)', 'first_date')}, {D('max(reference_date)', 'latest_date')}, {R('arg_max(index_value, reference_date)', 'latest_value')}, TRUE AS connected FROM cpi")
def _(spark, sf):
    return vr.reference_description(_reference(spark, sf)).select("records", "first_date", "latest_date", "latest_value", "connected")


@query("v11_alignment", """SELECT count(*) FILTER (c.month IS NOT NULL) AS overlapping_months, CASE WHEN (SELECT count(*) FROM cpi) = 0 THEN 'NOT_CONNECTED' WHEN count(c.month) > 0 THEN 'CONNECTED' ELSE 'NO_OVERLAP' END AS status,
  coalesce(string_agg(c.month, ',' ORDER BY c.month), '') AS aligned_months FROM (SELECT DISTINCT month FROM common) c""")
def _(spark, sf):
    return _report(spark, sf).alignment


@query("v11_empty_reference", "SELECT 0 AS overlapping_months, 'NOT_CONNECTED' AS status, '' AS aligned_months, min(CAST(observation_date AS VARCHAR)) || ' to ' || max(CAST(observation_date AS VARCHAR)) AS period FROM orderidx WHERE booking_window = 'T+15'")
def _(spark, sf):
    report = vr.validation_report(fr.long_results(spark, sf), fr.history(spark, sf).grid, _reference(spark, sf).filter(F.lit(False)))
    return report.alignment.withColumn("overlapping_months", F.col("overlapping_months").cast("int")).crossJoin(report.period)

