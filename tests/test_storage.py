import datetime as dt

import pytest
from conftest import DAY, raw_row
from pyspark.sql import functions as F

from fareindex.operators import cleaning as cl, index as ix
from fareindex.plans import jobs
from fareindex.schemas import INDEX_RESULTS, ROUTE_INDICES, STORED_FARES
from fareindex.sources import cpi, quotes, stores
from fareindex.streaming import ingest


def flights(day, factor, start):
    rows = []
    for i in range(6):
        total = round((4000 + 100 * i) * factor, 2)
        rows.append(raw_row(start + i, origin="BLR", destination="DEL", observation_date=day, travel_date=day + dt.timedelta(days=7), flight_number=f"F{i}",
                            observation_timestamp=dt.datetime(day.year, day.month, day.day, 8), base_fare=total * 0.82, taxes=total * 0.15,
                            mandatory_charges=total * 0.03, total_fare=total, source="IGNAV"))
    return rows + [(start + 90,) + rows[0][1:]]


@pytest.fixture
def by_day(raw):
    days = {DAY: flights(DAY, 1.0, 0), DAY + dt.timedelta(days=1): flights(DAY + dt.timedelta(days=1), 1.02, 1000),
            DAY + dt.timedelta(days=2): flights(DAY + dt.timedelta(days=2), 1.05, 2000)}
    return lambda day: raw(*days[day])


def test_cold_start_then_incremental(spark, by_day, tmp_path):
    root, weights = str(tmp_path), ix.build_weights(spark.createDataFrame([("BLR-DEL", 1.0, "W", 0)], "route string, weight double, version string, ordinal int"))
    at = dt.datetime(2026, 8, 21, 20)
    run, added, cold = jobs.run_day(spark, by_day, root, DAY + dt.timedelta(days=1), at, weights=weights)
    assert cold and added == 12
    row = run.national.filter("booking_window = 'T+7'").first()
    assert row.national_index == pytest.approx(102.0, abs=0.01) and row.status == "SUCCESS"
    stored = stores.read_table(spark, f"{root}/{jobs.OBSERVATIONS}", STORED_FARES)
    assert stored.count() == 12 and stored.filter("quality_status = 'EXCLUDED'").count() == 0
    assert stores.read_table(spark, f"{root}/{jobs.RESULTS}", INDEX_RESULTS).count() == 10
    assert stores.read_table(spark, f"{root}/{jobs.ROUTE_RESULTS}", ROUTE_INDICES).filter("contribution = 2.0000").count() == 1
    _, added, cold = jobs.run_day(spark, by_day, root, DAY + dt.timedelta(days=2), at, weights=weights)
    assert not cold and added == 6
    with pytest.raises(ValueError, match="immutable"):
        jobs.run_day(spark, by_day, root, DAY + dt.timedelta(days=2), at, weights=weights)
    # A later run of the same day is a new version; its observations are known.
    _, added, _ = jobs.run_day(spark, by_day, root, DAY + dt.timedelta(days=2), at + dt.timedelta(hours=1), weights=weights)
    assert added == 0
    versions = stores.read_table(spark, f"{root}/{jobs.RESULTS}", INDEX_RESULTS).filter(F.col("observation_date") == F.lit(DAY + dt.timedelta(days=2))).select("calculation_version").distinct()
    assert versions.count() == 2


def test_failed_second_append_is_completed(spark, by_day, tmp_path, monkeypatch):
    root, weights = str(tmp_path), ix.build_weights(spark.createDataFrame([("BLR-DEL", 1.0, "W", 0)], "route string, weight double, version string, ordinal int"))
    at, day = dt.datetime(2026, 8, 21, 20), DAY + dt.timedelta(days=1)
    jobs.run_day(spark, by_day, root, day, at - dt.timedelta(hours=1), weights=weights)
    real = stores._append

    def broken(df, path, partition_by=None):
        if path.endswith(jobs.RESULTS):
            raise OSError("disk")
        real(df, path, partition_by)

    monkeypatch.setattr(stores, "_append", broken)
    with pytest.raises(OSError):
        jobs.run_day(spark, by_day, root, day, at, weights=weights)
    monkeypatch.setattr(stores, "_append", real)
    jobs.run_day(spark, by_day, root, day, at, weights=weights)
    mine = F.col("calculation_version").endswith(at.strftime("%Y%m%d%H%M%S"))
    assert stores.read_table(spark, f"{root}/{jobs.RESULTS}", INDEX_RESULTS).filter(mine).count() == 5
    assert stores.read_table(spark, f"{root}/{jobs.ROUTE_RESULTS}", ROUTE_INDICES).filter(mine).count() == 5


def test_null_timestamps_are_refused_once_and_for_all(spark, raw, tmp_path):
    rows = cl.clean(raw(*flights(DAY, 1.0, 0))).observations.withColumn("observation_timestamp", F.when(F.col("ingest_seq") > 2, F.col("observation_timestamp")))
    assert stores.without_timestamp(rows).count() > 0
    first = stores.persist_observations(rows, str(tmp_path / "t"))
    assert 0 < first < 6 and stores.persist_observations(rows, str(tmp_path / "t")) == 0


def test_persist_is_idempotent(spark, raw, tmp_path):
    rows = cl.clean(raw(*flights(DAY, 1.0, 0))).observations
    assert stores.persist_observations(rows, str(tmp_path / "t")) == 6
    assert stores.persist_observations(rows, str(tmp_path / "t")) == 0


def test_streaming_equals_batch(spark, raw, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "out")
    frame = raw(*flights(DAY, 1.0, 0))
    frame.repartition(3).write.parquet(landing)
    ingest.run_ingest(ingest.raw_stream(spark, landing, files_per_batch=1), table, str(tmp_path / "c1"))
    assert stores.read_table(spark, table, STORED_FARES).count() == 6
    # The same file again, and a late older day: the repeat adds nothing, the late day is kept.
    frame.unionByName(raw(*flights(DAY - dt.timedelta(days=40), 1.0, 5000))).coalesce(1).write.mode("append").parquet(landing)
    ingest.run_ingest(ingest.raw_stream(spark, landing, files_per_batch=1), table, str(tmp_path / "c1"))
    assert stores.read_table(spark, table, STORED_FARES).count() == 12


def test_checked_append_and_routes(spark, raw, tmp_path):
    frame = cl.normalize(raw(raw_row(1), raw_row(2, airline="A" * 30)))
    bad = stores.append_checked(frame, str(tmp_path / "t")).collect()
    assert [r.violations for r in bad] == [["airline: length"]]
    stores.upsert_routes(frame, str(tmp_path / "r"))
    stores.upsert_routes(frame, str(tmp_path / "r"))
    assert [tuple(r) for r in stores.read_table(spark, str(tmp_path / "r"), stores.ROUTES_SCHEMA).collect()] == [("DEL-BOM", "DEL", "BOM", True)]


def test_fixed_base_job_is_rerunnable(spark, raw, tmp_path):
    frame = raw(*flights(DAY, 1.0, 0), *flights(DAY + dt.timedelta(days=1), 1.1, 100))
    weights = ix.build_weights(spark.createDataFrame([("BLR-DEL", 1.0, "W", 0)], "route string, weight double, version string, ordinal int"))
    for _ in range(2):
        run = jobs.run_fixed_base(spark, frame, str(tmp_path), dt.datetime(2026, 8, 22), weights)
    assert run.national.filter("booking_window = 'T+7'").first().national_index == pytest.approx(110.0, abs=0.01)
    assert stores.read_table(spark, f"{tmp_path}/{jobs.RESULTS}", INDEX_RESULTS).count() == 5


SHEET = ("base_year int, series string, year int, month string, state string, sector string, division string, `group` string, `class` string, "
         "sub_class string, item string, code string, `index` string, inflation double, imputation string")


def sheet_row(month, value, year=2025, item="Airfare"):
    from fareindex.constants import CPI_FILTER as f

    return (2024, f["series"], year, month, f["state"], f["sector"], f["division"], f["group"], f["class"], f["sub_class"], item, f["code"], value, None, "No")


def test_reference_series(spark, tmp_path):
    frame = spark.createDataFrame([sheet_row("february", "116.5"), sheet_row("January", "115.05"), sheet_row("March", "1", item="Rail")], SHEET)
    series = cpi.national_series(frame)
    assert [(r.reference_date.month, r.index_value) for r in series.collect()] == [(1, 115.05), (2, 116.5)]
    assert cpi.latest_airfare(frame).first().month == "february"
    path = str(tmp_path / "ref")
    assert (stores.load_reference(series, path), stores.load_reference(series, path)) == (2, 0)
    for rows, message in (([sheet_row("May", "1"), sheet_row("may", "2")], "Duplicate monthly"), ([sheet_row("May", "x")], "non-numeric"),
                          ([sheet_row("Mai", "1")], "Unrecognized month"), ([sheet_row("May", "0")], "strictly positive")):
        with pytest.raises(Exception, match=message):
            cpi.national_series(spark.createDataFrame(rows, SHEET)).collect()
    with pytest.raises(ValueError):
        cpi.require_rows(cpi.national_series(frame.filter("item = 'Rail'")))
    with pytest.raises(ValueError, match="missing expected columns"):
        cpi.check_columns(frame.drop("code"))


def test_itineraries(spark):
    good = ('{"ignav_id":"i1","cabin_class":"economy","bags":"1x15","price":{"amount":5200.5,"status":"ok"},'
            '"outbound":{"carrier":"IndiGo","segments":[{"departure_time_local":"2026-08-27T07:30:00","flight_number":"6E1"}]}}')
    bad = ['{"price":{"amount":1},"outbound":{"segments":[]}}', '{"outbound":{"segments":[{"departure_time_local":"2026-08-27T07:30:00"}]}}',
           '{"price":{"amount":1},"outbound":{"segments":[{"departure_time_local":"soon"}]}}', "not json"]
    frame = spark.createDataFrame([("DEL", t) for t in [good, *bad]], "origin string, itinerary string")
    rows = quotes.flatten_itineraries(frame).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.airline, row.departure_time, row.cabin_class, row.fare_type, row.total_fare, row.currency, row.source) == (
        "IndiGo", "07:30", "ECONOMY", "UNKNOWN", 5200.5, "INR", "ignav")
    assert row.metadata["ignav_id"] == "i1" and row.metadata["requires_self_transfer"] == "false"


def test_batch_holds_what_the_append_needs(spark, raw, tmp_path, monkeypatch):
    seen, plain = [], ingest.persist_observations
    monkeypatch.setattr(ingest, "persist_observations", lambda rows, *a, **b: seen.extend(rows.columns) or plain(rows, *a, **b))
    quotes = raw(raw_row(1), raw_row(2), raw_row(3, flight_number="7"), raw_row(4, airline=None, base_fare=1e300))
    path = str(tmp_path / "t")
    ingest.append_batch(ingest.assessed_stream(quotes), 0, path, "s")
    assert not {"origin", "destination", "lead_days", "quality_reason"} & set(seen) and {"ingest_seq", "metadata"} <= set(seen)
    assert tuple(ingest.ledger(spark, path).select("rows", "rejected", "added").first()) == (4, 1, 2)


def test_few_landing_files_hold_many_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from fareindex.sources import testdata

    monkeypatch.setattr(testdata, "LANDING_GROUP", 16 << 10)
    rows = spark.range(20000).select(F.col("id").alias("ingest_seq"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    testdata.land(rows, str(tmp_path / "landing"), 2)
    files = list((tmp_path / "landing").glob("*.parquet"))
    assert len(files) == 2 and all(pq.ParquetFile(f).num_row_groups > 3 for f in files)
    assert spark.read.parquet(str(tmp_path / "landing")).exceptAll(rows).isEmpty()
