import datetime as dt

import pytest
from conftest import obs_row
from pyspark.sql import functions as F

from fareindex.functions.local import small_table
from fareindex.operators import evaluation as ev, features, quality, readside, signals, validation as va
from fareindex.plans import validation_report as vr

D0, D1 = dt.date(2026, 9, 1), dt.date(2026, 9, 2)
GRID = "observation_date date, route string, booking_window string, index_value double, previous_index double"


def test_labelled_anomalies(spark):
    cases = [(100.2, False), (99.5, False), (105.0, True), (110.0, True), (120.0, True), (95.0, True), (90.0, True), (80.0, True)]
    frame = small_table(spark, [(D1, f"R-{i}", "T+7", c, 100.0) for i, (c, _) in enumerate(cases)], GRID)
    found = {r.route: r.detected for r in signals.detect_anomalies(frame).collect()}
    assert found == {f"R-{i}": e for i, (_, e) in enumerate(cases)}
    odd = small_table(spark, [(D1, "A", "T+7", 5.0, 0.0), (D1, "B", "T+7", None, 1.0)], GRID)
    reasons = {r.route: (r.detected, r.reason) for r in signals.detect_anomalies(odd).collect()}
    assert reasons["A"] == (False, "Previous index is zero; percentage change cannot be calculated.")
    assert reasons["B"] == (False, "Insufficient data for anomaly detection.")


@pytest.mark.parametrize(
    "moves, confirmed, expected, stage",
    [
        ({"DEL-BOM": (101.0, 1.0)}, [], False, "NORMAL"),
        ({"DEL-BOM": (125.0, 5.0)}, [], False, "ACCELERATION"),
        ({"DEL-BOM": (120.0, 5.0), "BOM-BLR": (118.0, 4.0)}, [], False, "MULTIPLE_ROUTES"),
        ({"DEL-BOM": (120.0, 5.0), "BOM-BLR": (118.0, 4.0)}, ["DEL-BOM", "BOM-BLR"], True, "POTENTIAL_AIRFARE_SHOCK"),
    ],
)
def test_labelled_shocks(spark, moves, confirmed, expected, stage):
    grid = small_table(spark, [(D1, r, "T+7", c, 100.0) for r, (c, _) in moves.items()], GRID)
    earlier = small_table(spark, [(D1, r, "T+7", p) for r, (_, p) in moves.items()], "observation_date date, route string, booking_window string, previous_change double")
    sure = small_table(spark, [(D1, r, "T+7", True) for r in confirmed], "observation_date date, route string, booking_window string, confirmed boolean")
    groups = small_table(spark, [(D1, "T+7", 0.95, 2.0)], "observation_date date, booking_window string, coverage_ratio double, freshness_hours double")
    row = signals.detect_shocks(signals.shock_movements(grid, earlier), groups, sure).first()
    assert (row.detected, row.stage) == (expected, stage)
    unknown = groups.withColumn("freshness_hours", F.lit(None).cast("double"))
    assert not signals.detect_shocks(signals.shock_movements(grid, earlier), unknown, sure).first().detected


def test_shock_without_routes(spark):
    grid = small_table(spark, [(D1, "A-B", "T+7", None, 100.0)], GRID)
    groups = small_table(spark, [(D1, "T+7", 0.9, 1.0)], "observation_date date, booking_window string, coverage_ratio double, freshness_hours double")
    row = signals.detect_shocks(signals.shock_movements(grid), groups).first()
    assert (row.comparable_route_count, row.severity, row.stage, row.coverage_ok, row.coverage_ratio) == (0, "NONE", "NORMAL", False, None)
    assert row.reason.startswith("Insufficient comparable")


def _sources(obs, moves):
    rows = []
    for source, (before, now) in moves.items():
        rows += [obs_row(D0, before, source=source), obs_row(D1, now, source=source)]
    return signals.confirm_sources(signals.source_movements(signals.source_means(obs(*rows)))).collect()


def test_cross_source(obs):
    strong = _sources(obs, {"A": (100, 110), "B": (100, 105), "C": (100, 103)})[0]
    assert (strong.direction, strong.strength, strong.confirmed, strong.agreement_ratio) == ("UPWARD", "STRONG", True, 1.0)
    three = _sources(obs, {"A": (100, 110), "B": (100, 105), "C": (100, 103), "D": (100, 90)})[0]
    assert (three.agreement_ratio, three.strength, three.agreeing_sources) == (0.75, "STRONG", ["A", "B", "C"])
    tie = _sources(obs, {"A": (100, 110), "B": (100, 90)})[0]
    assert (tie.direction, tie.confirmed, tie.strength) == ("UPWARD", False, "WEAK")
    alone = _sources(obs, {"A": (100, 110)})[0]
    assert (alone.strength, alone.status, alone.direction) == ("INSUFFICIENT", "INSUFFICIENT_DATA", None)


def test_scores(spark):
    frame = small_table(spark, [(20.0, 100.0, 1.0)], "percentage_change double, anomaly_score double, agreement_ratio double")
    row = signals.pressure_score(frame).first()
    assert (row.pressure_score, row.pressure_level) == (100.0, "VERY_HIGH")
    assert row.pressure_reason.startswith("Fare pressure score is 100.0/100 because the fare increased by 20.00%.")
    frame = small_table(spark, [(1.0, 1.0, True), (0.2, 0.0, False), (None, 1.0, True)], "coverage_ratio double, agreement_ratio double, anomaly_available boolean")
    rows = [(r.confidence_score, r.confidence_level) for r in signals.confidence_score(frame).collect()]
    assert rows == [(100.0, "VERY_HIGH"), (10.0, "LOW"), (None, "INSUFFICIENT_DATA")]


@pytest.mark.parametrize("values, pattern", [((110, 108, 105, 102), "DOWNWARD"), ((100, 101, 100.5, 101.2), "STABLE"), ((1, 2.5, 4, 5), "UPWARD"), ((1, 2), "INSUFFICIENT_DATA")])
def test_patterns(spark, values, pattern):
    rows = [("R", "T+7", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    frame = small_table(spark, rows, "route string, booking_window string, observation_date date, index_value double")
    assert features.latest_pattern(frame).first().pattern == pattern


def test_features(spark):
    rows = [("R", "T+7", D0 + dt.timedelta(days=i), v) for i, v in enumerate([1000.0, 1050.0, 1260.0, 0.0])]
    frame = small_table(spark, rows, "route string, booking_window string, observation_date date, fare double")
    moved = features.movement(frame, "fare").orderBy("observation_date").collect()
    assert [(r.percentage_change, r.acceleration) for r in moved] == [(None, None), (5.0, None), (20.0, 15.0), (None, None)]
    last = features.rolling(frame, "fare", size=2).orderBy("observation_date").collect()[-1]
    assert (last.rolling_mean, last.rolling_median, last.rolling_volatility) == (1155.0, 1155.0, 105.0)


def test_missing_fare_estimate(obs):
    rows = quality.missing_fare_estimate(obs(*[obs_row(D0, f, str(f)) for f in (5000, 5200, 5100)], obs_row(D0, 9, route="BLR-DEL"))).collect()
    found = {r.route: (r.estimated_fare, r.confidence) for r in rows}
    assert found == {"DEL-BOM": (5100.0, "MODERATE"), "BLR-DEL": (None, "INSUFFICIENT_DATA")}


def test_coverage_measures(spark, obs):
    frame = obs(obs_row(D0, 5), obs_row(D0, 5, route="BLR-DEL", window="T+1"), obs_row(D0, 5, route="XXX-YYY", window="T+15"))
    expected = quality.expected_values(frame, "route", ["DEL-BOM", "BLR-DEL", "BOM-DEL", "DEL-BLR"])
    assert quality.coverage(frame, expected, "route").first().route_coverage == 0.5
    assert quality.window_coverage(frame).first().booking_window_coverage == pytest.approx(0.6)
    assert quality.coverage(frame, expected.filter("false"), "route").first().route_coverage == 0.0
    assert {r.quality_status: r.observations for r in quality.status_counts(frame).collect()} == {"VALID": 3, "SUSPECT": 0, "EXCLUDED": 0, "OUTLIER": 0}


def _series(spark, values, window="T+7", start=D0):
    return small_table(spark, [(window, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if v is not None],
                       "booking_window string, observation_date date, index_value double")


def _metrics(spark, a, b, days=30):
    end = F.lit(D0 + dt.timedelta(days=days - 1))
    metrics, summary = vr.backtest(_series(spark, a), _series(spark, b), F.lit(D0), end)
    return {r.metric: r for r in metrics.filter("booking_window = 'T+7'").collect()}, {r.booking_window: r for r in summary.collect()}


def test_validation_statistics(spark):
    m, _ = _metrics(spark, (102, 97, 105), (100, 100, 101))
    assert m["mae"].value == pytest.approx(3.0) and m["rmse"].value == pytest.approx((29 / 3) ** 0.5)
    m, _ = _metrics(spark, (1, 2, 3, 4), (1, 8, 27, 64))
    assert m["spearman_correlation"].value == pytest.approx(1.0) and m["directional_accuracy"].value == 1.0
    m, _ = _metrics(spark, (5, 5, 5), (1, 2, 3))
    assert m["pearson_correlation"].value is None and m["pearson_correlation"].status == "UNDEFINED_VARIANCE"
    m, _ = _metrics(spark, (100, 102, 105, 103), (1, 2, 3, 4))
    assert m["stability"].value == pytest.approx(7 ** 0.5) and m["stability"].sample_size == 3
    m, _ = _metrics(spark, (1,), (1,))
    assert (m["pearson_correlation"].status, m["stability"].status, m["mae"].value) == ("INSUFFICIENT_DATA", "INSUFFICIENT_DATA", 0.0)


def test_backtest(spark):
    reference = [100 + (i % 7) for i in range(30)]
    m, s = _metrics(spark, [v + 0.5 for v in reference], reference)
    assert (m["mae"].value, m["coverage"].value) == (pytest.approx(0.5), 1.0) and m["pearson_correlation"].value == pytest.approx(1.0)
    assert (s["T+7"].matched_days, s["T+7"].status, s["T+7"].warning) == (30, "COMPLETED", None)
    m, s = _metrics(spark, [v if i < 20 else None for i, v in enumerate(reference)], reference)
    assert m["coverage"].value == pytest.approx(20 / 30) and "Missing 10 dates" in s["T+7"].warning
    assert s["T+1"].matched_days == 0
    with pytest.raises(Exception, match="Invalid date range"):
        vr.backtest(_series(spark, (1,)), _series(spark, (1,)), F.lit(D1), F.lit(D0))[1].collect()


def test_average_ranks(spark):
    frame = spark.createDataFrame([("g", v) for v in (10.0, 20.0, 20.0, 30.0)], "g string, v double")
    assert sorted(r.k for r in va.average_ranks(frame, "v", "k", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_detector_evaluation(spark):
    rows = [("d", i, a, p) for i, (a, p) in enumerate([(True, True), (False, False), (True, False), (False, True), (False, False)])]
    frame = small_table(spark, rows, "name string, step int, actual boolean, predicted boolean")
    row = ev.evaluate_detector(frame, "x", ["name", "step"], by=["name"]).first()
    assert (row.true_positive, row.true_negative, row.false_positive, row.false_negative) == (1, 2, 1, 1)
    assert (row.precision, row.recall, row.f1_score, row.false_positive_rate, row.detection_delay) == (0.5, 0.5, 0.5, pytest.approx(1 / 3), 0)
    late = small_table(spark, [("d", 0, False, False), ("d", 1, True, False), ("d", 2, True, True)], "name string, step int, actual boolean, predicted boolean")
    assert ev.detection_delay(late, by=["name"]).first().detection_delay == 1


def test_simulation(spark):
    results = small_table(spark, [(D0, "T+15", 120.0, "SUCCESS"), (D1, "T+15", 110.0, "SUCCESS")], "observation_date date, booking_window string, index_value double, status string")
    results = results.withColumn("calculation_timestamp", F.col("observation_date").cast("timestamp"))
    scenarios = small_table(spark, [("del-bom", 10.0, None), ("BLR-DEL", 10.0, None), ("BOM-DEL", 5.0, 150.0), ("bad", 1.0, None)], "route string, shock_percent double, projected_index double")
    weights = small_table(spark, [("DEL-BOM", 0.25)], "route string, weight double")
    rows = {r.route: (r.projected_index, r.impact_points) for r in readside.simulate(scenarios, results, weights).collect()}
    assert rows == {"DEL-BOM": (112.75, 2.75), "BLR-DEL": (111.1, 1.1), "BOM-DEL": (150.0, 40.0)}
    with pytest.raises(ValueError):
        readside.read_filter(results, "2026-02-02", "2026-01-01")
