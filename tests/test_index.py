import datetime as dt
import math

import pytest
from conftest import obs_row
from pyspark.sql import functions as F

from fareindex.functions.local import small_table
from fareindex.operators import index as ix, pairing
from fareindex.plans import calculation as calc
from fareindex.schemas import WEIGHTS

D0, D1, D2, D4 = (dt.date(2026, 9, d) for d in (1, 2, 3, 5))


def weights(spark, values, version="W1"):
    return small_table(spark, [(r, float(w), version, "USER_CONFIGURED", None, False, i) for i, (r, w) in enumerate(values.items())], WEIGHTS)


def jevons(spark, values):
    frame = spark.createDataFrame([("g", v) for v in values], "g string, relative double")
    return ix.jevons(frame, ["g"]).first()


def test_jevons(spark):
    assert jevons(spark, [1.25]).index_value == pytest.approx(125.0)
    assert jevons(spark, [1.25, 1.0, 1.25]).index_value == pytest.approx(116.0397208403, abs=1e-9)
    assert jevons(spark, [1.2, 0.8]).index_value == pytest.approx(math.sqrt(0.96) * 100)
    row = jevons(spark, [0.0, -1.5, float("nan"), 1.2])
    assert (row.valid_pairs, row.index_value) == (1, pytest.approx(120.0))
    assert jevons(spark, [0.0]).status == "INSUFFICIENT_DATA"
    assert jevons(spark, [1.3, 0.7]).index_value * jevons(spark, [1 / 1.3, 1 / 0.7]).index_value == pytest.approx(1e4)


def test_pairs_lowest_fare_and_counts(obs):
    frame = obs(obs_row(D0, 4800), obs_row(D1, 5200), obs_row(D1, 5000, source="B"), obs_row(D1, 7000, "202"), obs_row(D0, 6000, "203"),
                obs_row(D1, 1.0, "204", status="EXCLUDED"), obs_row(D0, 2.0, "204"), obs_row(D1, 3.0, "205", status="SUSPECT"), obs_row(D0, 3.0, "205"),
                obs_row(D1, 3.3, "206", status="OUTLIER"), obs_row(D0, 3.0, "206"))
    products = pairing.consecutive_products(frame)
    pairs = {(r.current_fare, r.previous_fare) for r in pairing.matched_pairs(products).filter(F.col("observation_date") == F.lit(D1)).collect()}
    assert pairs == {(5000.0, 4800.0), (3.3, 3.0)}
    row = pairing.pairing_diagnostics(products).filter(F.col("observation_date") == F.lit(D1)).first()
    assert (row.matched, row.unmatched_current, row.unmatched_previous, row.duplicate_fingerprints) == (2, 1, 3, 1)
    suspect = pairing.matched_pairs(pairing.consecutive_products(frame, allow_suspect=True))
    assert suspect.filter(F.col("observation_date") == F.lit(D1)).count() == 3


def _three_routes(obs):
    factors = {"DEL-BOM": 1.10, "BOM-BLR": 0.95, "DEL-BLR": 1.05}
    rows = []
    for route, factor in factors.items():
        for window in ("T+1", "T+7", "T+15", "T+30", "T+45"):
            for flight, fare in (("1", 4000.0), ("2", 6000.0)):
                rows += [obs_row(D0, fare, flight, route, window), obs_row(D1, fare * factor, flight, route, window)]
    return obs(*rows)


def test_end_to_end(spark, obs):
    stored = small_table(spark, [(r, w, 100.0) for r in ("DEL-BOM", "BOM-BLR", "DEL-BLR") for w in ("T+1", "T+7", "T+15", "T+30", "T+45")],
                         "route string, booking_window string, index_value double").withColumn("calculation_timestamp", F.lit("2026-09-01").cast("timestamp"))
    frame = _three_routes(obs)
    on = lambda d: frame.filter(F.col("observation_date") == F.lit(d))
    run = calc.daily_index(on(D1), on(D0), F.lit(D1), F.lit(D0), weights(spark, {"DEL-BOM": 0.5, "BOM-BLR": 0.3, "DEL-BLR": 0.2}), stored_previous=stored)
    national = run.national.collect()
    assert len(national) == 5
    for row in national:
        assert row.national_index == pytest.approx(104.5) and row.coverage_ratio == 1.0 and row.status == "SUCCESS" and row.warnings == []
    parts = {r.route: r for r in run.contributions.filter("booking_window = 'T+7'").collect()}
    assert {k: round(v.point_contribution, 6) for k, v in parts.items()} == {"DEL-BOM": 5.0, "BOM-BLR": -1.5, "DEL-BLR": 1.0}
    assert sum(r.percentage_share_of_change for r in parts.values()) == pytest.approx(100.0)
    assert sum(r.level_contribution for r in parts.values()) == pytest.approx(104.5)
    assert run.overall_status(False).first().status == "SUCCESS"
    again = calc.daily_index(on(D1), on(D0), F.lit(D1), F.lit(D0), weights(spark, {"DEL-BOM": 0.5, "BOM-BLR": 0.3, "DEL-BLR": 0.2}), stored_previous=stored)
    assert run.checksums().first().execution_checksum == again.checksums().first().execution_checksum


def _grid(spark, values, window="T+7"):
    return small_table(spark, [(D1, r, window, None if v is None else float(v), "SUCCESS" if v is not None else "INSUFFICIENT_DATA", None) for r, v in values.items()],
                       "observation_date date, route string, booking_window string, index_value double, status string, previous_index double")


def test_coverage_policy(spark):
    w = weights(spark, {"A-B": 0.5, "B-C": 0.3, "C-D": 0.2})
    full = ix.national_index(_grid(spark, {"A-B": 120, "B-C": 110, "C-D": 105}), w).first()
    assert (full.national_index, full.status) == (pytest.approx(114.0), "SUCCESS")
    missing = _grid(spark, {"A-B": 120, "B-C": 103.33333333333333})
    strict = ix.national_index(missing, w).first()
    assert strict.national_index is None and strict.status == "INSUFFICIENT_DATA" and "strict" in strict.warnings[1]
    part = ix.national_index(missing, w, allow_partial=True).first()
    assert (part.national_index, part.status, part.coverage_ratio) == (pytest.approx(113.75), "PARTIAL_COVERAGE", pytest.approx(0.8))
    assert part.warnings == ["Missing route data for weighted routes: ['C-D']. Coverage: 80.00%"]
    low = ix.national_index(_grid(spark, {"C-D": 105}), w, allow_partial=True).first()
    assert low.national_index is None and low.warnings[1] == "Coverage 20.00% is below threshold 50.00%"
    none = ix.national_index(_grid(spark, {"X-Y": 105}), w, allow_partial=True).first()
    assert none.coverage_ratio == 0.0 and none.warnings[1].startswith("No observed routes")
    # A route outside the basket has weight 0, in partial mode too.
    extra = ix.national_index(_grid(spark, {"A-B": 120, "B-C": 103.33333333333333, "X-Y": 999}), w, allow_partial=True).first()
    assert extra.national_index == pytest.approx(113.75)
    bad = ix.national_index(missing, weights(spark, {"A-B": 0.5, "B-C": 0.1}), allow_partial=True).first()
    assert bad.status == "FAILED" and bad.national_index is None and bad.warnings == ["Weights do not sum to 1.0 (actual sum: 0.600000)"]


def test_contributions(spark):
    grid = _grid(spark, {"A-B": 110, "B-C": 95}).withColumn("previous_index", F.lit(100.0))
    w = weights(spark, {"A-B": 0.6, "B-C": 0.4})
    rows = {r.route: r for r in ix.contributions(grid, w).collect()}
    assert (rows["A-B"].level_contribution, rows["B-C"].level_contribution) == (pytest.approx(66.0), pytest.approx(38.0))
    assert (rows["A-B"].percentage_share_of_change, rows["B-C"].percentage_share_of_change) == (pytest.approx(150.0), pytest.approx(-50.0))
    rows = ix.contributions(_grid(spark, {"A-B": 110, "B-C": 95}), w).collect()
    assert all(r.point_contribution is None and r.percentage_share_of_change is None for r in rows)
    still = _grid(spark, {"A-B": 110, "B-C": 90}).withColumn("previous_index", F.when(F.col("route") == "A-B", 100.0).otherwise(105.0))
    assert all(r.percentage_share_of_change is None for r in ix.contributions(still, w).collect())


def test_gap_resets_the_previous_index(spark, obs):
    days = [D0, D1, D2, D4, D4 + dt.timedelta(days=1)]
    frame = obs(*[obs_row(d, 100.0 * (i + 1)) for i, d in enumerate(days)])
    run = calc.historical_index(frame, weights(spark, {"DEL-BOM": 1.0}), windows=("T+7",))
    rows = {r.observation_date: (round(r.index_value, 6), r.previous_index and round(r.previous_index, 6)) for r in run.grid.collect()}
    assert rows == {D1: (200.0, None), D2: (150.0, 200.0), D4 + dt.timedelta(days=1): (125.0, None)}
    gap = calc.calendar_gaps(frame).collect()
    assert [g.observation_date for g in gap] == [D4]


def test_dense_grid_and_raw_counts(spark, obs):
    frame = obs(obs_row(D0, 10), obs_row(D1, 11), obs_row(D1, 5, status="EXCLUDED"), obs_row(D0, 9, route="BLR-DEL"))
    run = calc.historical_index(frame, weights(spark, {"DEL-BOM": 1.0}))
    rows = run.grid.collect()
    assert len(rows) == 10
    hit = [r for r in rows if r.route == "DEL-BOM" and r.booking_window == "T+7"][0]
    assert (hit.num_current_observations, hit.num_previous_observations, hit.num_matched_pairs, hit.route_status) == (2, 1, 1, "SUCCESS")
    other = [r for r in rows if r.route == "BLR-DEL"]
    assert {r.status for r in other} == {"INSUFFICIENT_DATA"} and {r.route_status for r in other} == {"INSUFFICIENT_DATA"}


def test_fixed_base_carries_the_last_index(spark, obs):
    frame = obs(obs_row(D0, 100), obs_row(D1, 110), obs_row(D2, 50, "999"), obs_row(D4, 130))
    run = calc.fixed_base_index(frame, weights(spark, {"DEL-BOM": 1.0}), windows=("T+7",))
    rows = {r.observation_date: (r.index_value and round(r.index_value, 6), round(r.previous_index, 6)) for r in run.grid.collect()}
    assert rows == {D1: (110.0, 100.0), D2: (None, 110.0), D4: (130.0, 110.0)}


def test_weight_construction(spark):
    percent = ix.build_weights(spark.createDataFrame([("a-b", 60.0, "v"), ("b-c", 40.0, "v")], "route string, weight double, version string"))
    assert {r.route: r.weight for r in percent.collect()} == {"A-B": 0.6, "B-C": 0.4}
    raw = spark.createDataFrame([("a-b", 3.0, "v"), ("b-c", 1.0, "v")], "route string, weight double, version string")
    assert {r.weight for r in ix.build_weights(raw, auto_normalize=True).collect()} == {0.75, 0.25}
    with pytest.raises(Exception, match="must sum to 1.0"):
        ix.build_weights(raw).collect()


def test_plans_have_no_python_and_no_cartesian(spark, obs):
    run = calc.historical_index(_three_routes(obs), ix.demo_weights(spark), allow_partial=True)
    for frame in (run.national, run.contributions):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert plan.count("ExistingRDD") <= 1  # the quotes are read once


def test_several_weight_versions_need_a_choice(spark):
    grid = spark.createDataFrame([(D0, "DEL-BOM", "T+7", 110.0, "SUCCESS")], "observation_date date, route string, booking_window string, index_value double, status string")
    one = [("DEL-BOM", 1.0, "V1", 0)]
    weights = spark.createDataFrame(one + [("DEL-BOM", 1.0, "V2", 0)], "route string, weight double, version string, ordinal int")
    assert ix.national_index(grid, weights, version="V2").first().national_index == pytest.approx(110.0)
    with pytest.raises(ValueError, match="several versions"):
        ix.national_index(grid, weights)


def test_quantiles_of_small_numbers(spark):
    from fareindex.operators.quantiles import _band, exact_quantiles

    values = [(x * 1e-6,) for x in range(1, 1001)] + [(-x * 1e-9,) for x in range(1, 200)] + [(0.0,)]
    frame = spark.createDataFrame(values, "v double")
    assert frame.select(_band(F.col("v"))).distinct().count() > 500
    import numpy as np

    got = exact_quantiles(frame, [], "v", {"m": 0.5, "q": 0.9}).first()
    assert got.m == pytest.approx(np.quantile([v[0] for v in values], 0.5)) and got.q == pytest.approx(np.quantile([v[0] for v in values], 0.9))
