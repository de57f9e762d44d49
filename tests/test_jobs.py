"""Jobs over stored tables: figures of the writes, half-failed runs, histories that resume, the ledger of a stream."""

import datetime as dt
import re

import pytest
from conftest import DAY, raw_row
from pyspark.sql import functions as F
from test_storage import flights

from fareindex.operators import cleaning as cl, index as ix, readside as rs
from fareindex.plans import jobs
from fareindex.schemas import INDEX_RESULTS, QUALITY_METRICS, ROUTE_INDICES, STORED_FARES
from fareindex.sources import quotes, stores
from fareindex.streaming import ingest

ONE = dt.timedelta(days=1)
AT = dt.datetime(2026, 8, 21, 20)


@pytest.fixture(scope="module")
def weights(spark):
    return ix.build_weights(spark.createDataFrame([("BLR-DEL", 1.0, "W", 0)], "route string, weight double, version string, ordinal int")).cache()


def table(spark, root, name):
    schema = {jobs.RESULTS: INDEX_RESULTS, jobs.ROUTE_RESULTS: ROUTE_INDICES, jobs.EVENTS: jobs.EVENT_SCHEMA, jobs.OBSERVATIONS: STORED_FARES,
              jobs.QUALITY: QUALITY_METRICS, jobs.ROUTES: stores.ROUTES_SCHEMA}[name]
    return stores.read_table(spark, f"{root}/{name}", schema)


def rows(df, *leave):
    return sorted(str(tuple(r)) for r in df.drop(*leave).collect())


class Interrupted(Exception):
    pass


def interrupt(monkeypatch, match, after=0):
    """Writes to a path that matches fail from the given one on."""
    real, seen = stores._append, []

    def broken(df, path, partition_by=None):
        if re.search(match, path):
            seen.append(path)
            if len(seen) > after:
                raise Interrupted
        return real(df, path, partition_by)

    monkeypatch.setattr(stores, "_append", broken)
    return lambda: monkeypatch.setattr(stores, "_append", real)


def test_report_counts_what_the_writes_did(spark, raw, weights, tmp_path):
    bad = [raw_row(500, origin=None), raw_row(501, source="nobody")]
    days = {DAY: flights(DAY, 1.0, 0), DAY + ONE: flights(DAY + ONE, 1.05, 1000) + [tuple(r[:5]) + (DAY + ONE,) + tuple(r[6:]) for r in bad]}
    report = jobs.run_live(spark, lambda d: raw(*days[d]), str(tmp_path), DAY + ONE, AT, weights=weights, source="IGNAV", quote_source="IGNAV")
    summary = report.frame(spark).first().asDict()
    assert {k: summary[k] for k in ("total_processed", "observations_stored", "valid_observations", "duplicate_observations", "rejected_observations")} == {
        "total_processed": 16, "observations_stored": 12, "valid_observations": 12, "duplicate_observations": 2, "rejected_observations": 2}
    assert (summary["cold_start"], summary["historical_days"], summary["routes_processed"]) == (True, 2, 1)
    assert (summary["index_results_stored"], summary["route_indices_stored"], summary["intelligence_events_stored"]) == (10, 10, 1)
    assert summary["national_indices"] == {"T+7": 105.0} and summary["observation_date"] == DAY + ONE
    root = str(tmp_path)
    assert table(spark, root, jobs.RESULTS).count() == 10 and table(spark, root, jobs.ROUTE_RESULTS).count() == 10
    event = table(spark, root, jobs.EVENTS).first()
    assert (event.event_type, event.affected_sources, event.event_timestamp) == ("AIRFARE_SHOCK", ["IGNAV"], AT)
    quality = {(r.metric_date, r.source): r for r in table(spark, root, jobs.QUALITY).collect()}
    assert summary["quality_metrics_stored"] == len(quality)
    assert quality[DAY + ONE, "IGNAV"].observation_count == 7 and quality[DAY + ONE, "IGNAV"].invalid_observations == 1
    assert quality[DAY, "IGNAV"].generated_at == AT - ONE
    # Nothing of another source is paired: without its quotes the day before is cold again, and nothing is added twice.
    again = jobs.run_live(spark, lambda d: raw(*days[d]), root, DAY + ONE, AT + dt.timedelta(hours=1), weights=weights, quote_source="YATRA")
    assert again.cold_start and again.figures["observations_stored"] == 0 and again.national_indices == {}


def test_half_failed_run_is_invisible(spark, raw, weights, tmp_path, monkeypatch):
    root = str(tmp_path)
    by_day = lambda d: raw(*flights(d, 1.0 + 0.03 * (d - DAY).days, 1000 * (d - DAY).days))
    jobs.run_live(spark, by_day, root, DAY + ONE, AT, weights=weights)
    heal = interrupt(monkeypatch, jobs.RESULTS)
    with pytest.raises(Interrupted):
        jobs.run_live(spark, lambda d: raw(*flights(d, 9.0, 9000)), root, DAY + ONE, AT + dt.timedelta(hours=5), weights=weights)
    heal()
    results, routes = table(spark, root, jobs.RESULTS), table(spark, root, jobs.ROUTE_RESULTS)
    failed = f"CALC_{DAY + ONE}_20260822010000"
    assert routes.filter(F.col("calculation_version") == failed).count() == 5 and results.filter(F.col("calculation_version") == failed).count() == 0
    assert rs.finished(routes, results).filter(F.col("calculation_version") == failed).count() == 0
    shown = rs.latest_route_index(routes, "T+7", results).first()
    assert float(shown.index_value) == pytest.approx(103.0, abs=0.01)
    events = table(spark, root, jobs.EVENTS)
    assert rs.finished_events(events, results).count() == events.filter(F.col("event_timestamp") == F.lit(AT)).count()
    # The next day starts from the finished run, not from what the failed one left.
    jobs.run_live(spark, by_day, root, DAY + 2 * ONE, AT + ONE, weights=weights)
    day2 = table(spark, root, jobs.ROUTE_RESULTS).filter((F.col("observation_date") == F.lit(DAY + 2 * ONE)) & (F.col("booking_window") == "T+7")).first()
    assert float(day2.contribution) == pytest.approx(float(day2.index_value) - 103.0, abs=0.01)


def stored_days(spark, raw, root, offsets):
    made = [r for k in offsets for r in flights(DAY + k * ONE, 1.0 + 0.03 * (k % 4), 1000 * k)]
    stores.persist_observations(cl.clean(raw(*made)).observations, f"{root}/{jobs.OBSERVATIONS}")


@pytest.mark.parametrize("broken, after", [(jobs.ROUTE_RESULTS, 1), (jobs.RESULTS, 1), (jobs.EVENTS, 0)])
def test_history_goes_on_where_it_stopped(spark, raw, weights, tmp_path, monkeypatch, broken, after):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for root in (one, two):
        stored_days(spark, raw, root, [0, 1, 2, 3, 6, 7, 8])
    whole = jobs.run_history(spark, one, "H", AT, weights=weights)
    assert whole.historical_days == 5 and whole.figures["index_results_stored"] == 25
    assert whole.warnings == [f"Missing historical dates between {DAY + 3 * ONE} and {DAY + 6 * ONE}; no cross-gap calculation created."]
    heal = interrupt(monkeypatch, broken, after)
    with pytest.raises(Interrupted):
        jobs.run_history(spark, two, "H", AT, weights=weights, days_per_step=2)
    heal()
    rest = jobs.run_history(spark, two, "H", AT, weights=weights, days_per_step=2)
    assert rest.historical_days == 5 - 2 * after
    for name in (jobs.RESULTS, jobs.ROUTE_RESULTS, jobs.EVENTS):
        assert rows(table(spark, one, name)) == rows(table(spark, two, name))
    assert jobs.run_history(spark, two, "H", AT, weights=weights).historical_days == 0
    # No signal on the first transition and on the first one after the gap: they have no previous index.
    assert {r[0] for r in table(spark, one, jobs.EVENTS).select("observation_date").collect()} <= {DAY + k * ONE for k in (2, 3, 8)}
    assert table(spark, one, jobs.EVENTS).count() > 0
    with pytest.raises(ValueError):
        jobs.run_history(spark, two, "H", AT, weights=weights, days_per_step=0)


def test_fixed_base_job_seeds_the_base_day_and_reports(spark, raw, weights, tmp_path):
    root, report = str(tmp_path), jobs.Report("SYNTHETIC")
    frame = raw(*flights(DAY, 1.0, 0), *flights(DAY + ONE, 1.1, 100), *flights(DAY + 2 * ONE, 1.1, 200))
    for hours in (0, 1):
        report = jobs.Report("SYNTHETIC")
        jobs.run_fixed_base(spark, frame, root, AT + dt.timedelta(hours=hours), weights=weights, seed_base=True, report=report)
    summary = report.frame(spark).first()
    assert (summary.mode, summary.historical_days, summary.previous_observation_date, summary.routes_processed) == ("SYNTHETIC", 2, DAY, 1)
    assert (summary.index_results_stored, summary.route_indices_stored, summary.observations_stored) == (15, 15, 18)
    results = table(spark, root, jobs.RESULTS)
    assert results.count() == 15 and results.filter("calculation_version like '%_BASE' and index_value = 100").count() == 5
    seen = rs.finished_events(table(spark, root, jobs.EVENTS), results).collect()
    assert [(r.observation_date, r.event_type, r.event_timestamp) for r in seen] == [(DAY + ONE, "AIRFARE_SHOCK", AT + dt.timedelta(hours=1))]
    # Each run leaves its quality rows, as each has its time.
    quality = [(r.metric_date, r.observation_count) for r in table(spark, root, jobs.QUALITY).collect() if r.generated_at == AT + dt.timedelta(hours=1)]
    assert sorted(quality) == [(DAY, 7), (DAY + ONE, 7), (DAY + 2 * ONE, 7)] and table(spark, root, jobs.QUALITY).count() == 6


def test_unknown_weight_version_is_an_error(spark, weights):
    with pytest.raises(ValueError, match="no version V9"):
        ix.one_version(weights, "V9")
    assert jobs.resolve_weights(spark, weights, None).count() == 1


def test_stored_batch_is_computed_once_and_prunes_the_table(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    stores.persist_observations(cl.clean(raw(*flights(DAY - ONE, 1.0, 0))).observations, path)
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    clean = cl.clean(raw(*flights(DAY, 1.0, 0))).observations.drop("metadata").coalesce(1)
    counted = clean.mapInPandas(count, clean.schema).withColumn("metadata", F.create_map().cast("map<string,string>"))
    assert stores.persist_observations(counted, path) == 6 and passed.value == 7
    plan = stores.pruned_by(stores.read_table(spark, path, STORED_FARES), clean)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_replayed_batch_adds_nothing(spark, raw, tmp_path, monkeypatch):
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    raw(*flights(DAY, 1.0, 0), raw_row(700, origin=None)).coalesce(1).write.parquet(landing)
    real = ingest.note

    def crash(spark, table_path, stream, batch_id, state, *figures):
        if state == "committed":
            raise Interrupted
        real(spark, table_path, stream, batch_id, state, *figures)

    monkeypatch.setattr(ingest, "note", crash)
    with pytest.raises(Exception):
        ingest.run_ingest(ingest.raw_stream(spark, landing), path, str(tmp_path / "c"), stream="s")
    stored = stores.read_table(spark, path, STORED_FARES)
    assert stored.count() == 6 and ingest.ledger(spark, path).count() == 0
    monkeypatch.setattr(ingest, "note", real)
    ingest.run_ingest(ingest.raw_stream(spark, landing), path, str(tmp_path / "c"), stream="s")
    assert stores.read_table(spark, path, STORED_FARES).count() == 6
    row = ingest.ledger(spark, path).first()
    assert (row.stream, row.batch_id, row.rows, row.rejected, row.added) == ("s", 0, 8, 1, 6)
    # A batch that is in the ledger is not touched again.
    ingest.append_batch(spark.createDataFrame([], "x int"), 0, path, "s")
    assert ingest.ledger(spark, path).count() == 1


def test_assessed_rows_equal_the_two_cleaned_frames(spark, raw):
    frame = raw(*flights(DAY, 1.0, 0), raw_row(700, origin=None, metadata={"k": "v"}), raw_row(701, source="nobody"), raw_row(702, observation_status="cancelled"))
    two, one = cl.clean(frame), cl.split_assessed(cl.assessed(frame))
    for a, b in ((two.observations, one.observations), (two.rejected, one.rejected)):
        assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(a.columns)))
    assert rows(cl.cleaning_counts(two)) == rows(cl.assessed_counts(cl.assessed(frame)))


def scans(df) -> int:
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall("FileScan", final))


def test_quotes_are_read_twice_at_most(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ("d5_clean_quotes", "d6_cleaning_counts", "d14_daily_quality_metrics", "a13_quality_summary"):
        assert scans(queries[name](spark, "/root/testdata/sf0.001")) <= 2, name


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_and_sources_reach_the_scan_through_the_cleaning(spark, raw, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else the plan's text is cut
    path = str(tmp_path / "raw")
    frame = raw(*flights(DAY, 1.0, 0), *flights(DAY + ONE, 1.0, 100), raw_row(700, observation_date=None, source="IGNAV"), raw_row(701, source="YATRA"))
    frame.write.partitionBy("observation_date", "source").parquet(path)
    part = quotes.read_raw_quotes(spark, path, start=str(DAY), end=str(DAY), sources=("IGNAV",))
    whole = cl.clean(quotes.read_raw_quotes(spark, path)).observations.filter((F.col("observation_date") == F.lit(DAY)) & (F.col("source") == "IGNAV"))
    found = cl.clean(part).observations
    assert rows(found, "quality_status", "quality_reason", "metadata") == rows(whole, "quality_status", "quality_reason", "metadata") and found.count() == 8
    for df in (found, cl.clean(part).rejected, cl.assessed(part)):
        scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan_of(df))
        assert scans and all("observation_date" in s and "source" in s for s in scans)
    keys = cl.duplicate_keys(cl.accepted(part, metadata=False))
    assert "metadata" not in re.search(r"ReadSchema: (\S+)", plan_of(keys))[1]
    stored = str(tmp_path / "stored")
    stores.persist_observations(found, stored)
    plan = plan_of(quotes.read_stored_observations(spark, stored, str(DAY), "IGNAV").select("route", "comparable_fare"))
    assert "PartitionFilters: [isnotnull(observation_date" in plan and "base_fare" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_fixed_base_reads_the_quotes_once_besides_their_first_date(spark):
    import __spark_entry__ as entry

    assert scans(entry.queries()["a9_fixed_base_index"](spark, "/root/testdata/sf0.001")) <= 2


def test_signals_read_the_quotes_four_times_at_most(spark):
    import __spark_entry__ as entry

    df = entry.queries()["x5_detect_shocks"](spark, "/root/testdata/sf0.001")  # pairs and facts are written while it is built
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet [^\n]*events\.parquet", final)) <= 2


def test_facts_roll_up_to_the_direct_figures(spark, obs):
    from conftest import obs_row
    from fareindex.operators import quality, signals

    made = [obs_row(DAY, 100.0 + i, flight=str(i), source=s) for i, s in enumerate(["A", "b ", " B", "", "A"])] + [obs_row(DAY, -5.0), obs_row(DAY + ONE, 50.0)]
    frame = obs(*made)
    facts = signals.source_facts(frame)
    assert rows(signals.facts_means(facts)) == rows(signals.source_means(frame))
    direct = quality.source_volume(frame, ["observation_date", "route", "booking_window"])
    assert rows(signals.facts_slices(facts).select(*direct.columns)) == rows(direct)
    means = {(r.observation_date, r.route): r.baseline for r in signals.facts_slices(facts).collect()}
    assert means[DAY, "DEL-BOM"] == pytest.approx((100 + 101 + 102 + 103 + 104 - 5) / 6)
    assert {r.observation_date: r.observation_count for r in signals.facts_days(facts).collect()} == {DAY: 6, DAY + ONE: 1}
