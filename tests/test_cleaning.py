import datetime as dt
import hashlib

import pytest
from conftest import DAY, raw_row
from pyspark.sql import functions as F

from fareindex.functions import fares, fingerprints, text
from fareindex.operators import cleaning as cl
from fareindex.operators.quantiles import exact_quantiles


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, ""),
        ({"observation_status": "cancelled"}, "cancelled flight: CANCELLED"),
        ({"observation_status": "Sold  Out"}, "sold-out observation: SOLD_OUT"),
        ({"observation_status": "UNAVAILABLE"}, "unavailable observation: UNAVAILABLE"),
        ({"observation_status": "strange"}, ""),
        ({"origin": None}, "missing origin"),
        ({"destination": "  "}, "missing destination"),
        ({"travel_date": None}, "missing travel date: MISSING_TRAVEL_DATE"),
        ({"travel_date": dt.date(2026, 8, 1)}, "travel date is before observation date"),
        ({"source": None}, "missing source: MISSING_SOURCE"),
        ({"source": "somewhere"}, "UNKNOWN_SOURCE"),
        ({"airline": ""}, "missing airline"),
        ({"base_fare": None}, "missing base fare: MISSING_FARE"),
        ({"base_fare": -1.0}, "negative base fare"),
        ({"base_fare": float("nan")}, "negative base fare"),
        ({"taxes": None}, "missing taxes"),
        ({"taxes": 0.0}, "invalid taxes"),
        ({"mandatory_charges": None}, "missing mandatory charges"),
        ({"mandatory_charges": float("inf")}, "invalid mandatory charges"),
        ({"total_fare": -5.0}, "invalid total fare"),
        ({"total_fare": None}, ""),
        # The first failing rule wins.
        ({"observation_status": "CANCELLED", "origin": None}, "cancelled flight: CANCELLED"),
    ],
)
def test_classification(raw, changes, reason):
    assert cl.classify(raw(raw_row(**changes))).select("raw_reason").first()[0] == reason


def test_valid_row_is_normalized(raw):
    row = cl.accepted(raw(raw_row(origin=" del ", source="6e", metadata={"k": "v"}))).first()
    assert (row.origin, row.source, row.booking_window, row.comparable_fare, row.route) == ("DEL", "INDIGO", "T+7", 5300.0, "DEL-BOM")
    assert row.metadata["k"] == "v" and row.metadata["lead_days"] == "7"
    key = "DEL|BOM|2026-08-27|6E123|10:30|ECONOMY|STANDARD|15KG"
    assert row.fingerprint == hashlib.sha256(key.encode()).hexdigest()


def test_rejected_rows_keep_their_values_and_reason(raw):
    frame = raw(raw_row(1), raw_row(2, origin=None), raw_row(3, travel_date=DAY + dt.timedelta(days=3)), raw_row(4, destination="DEL"))
    rows = {r.ingest_seq: r for r in cl.rejected(frame).collect()}
    assert set(rows) == {2, 3, 4}
    assert rows[2].metadata == {"quality_status": "EXCLUDED", "quality_reason": "missing origin"}
    assert rows[3].reject_reason.startswith("Lead time of 3 days")
    assert rows[4].reject_reason == "Origin and destination cannot be the same"


def test_duplicates_first_in_order_stays(raw):
    later = dt.datetime(2026, 8, 20, 11, 0)
    frame = cl.accepted(raw(raw_row(5), raw_row(2), raw_row(9, observation_timestamp=later), raw_row(8, source="MOCK")))
    status = {r.ingest_seq: r.quality_status for r in cl.mark_duplicates(frame).collect()}
    assert status == {2: "VALID", 5: "EXCLUDED", 8: "VALID", 9: "VALID"}
    assert [r.ingest_seq for r in cl.find_duplicates(frame).collect()] == [5]
    assert cl.count_duplicates(frame).first()[0] == 1


def test_duplicates_of_a_null_timestamp(raw):
    frame = cl.accepted(raw(raw_row(1, observation_timestamp=None), raw_row(2, observation_timestamp=None)))
    assert {r.ingest_seq: r.quality_status for r in cl.mark_duplicates(frame).collect()} == {1: "VALID", 2: "EXCLUDED"}


def _fare_rows(fares_):
    return [raw_row(i, flight_number=f"F{i}", base_fare=f - 200.0, taxes=150.0, mandatory_charges=50.0, total_fare=f) for i, f in enumerate(fares_)]


def test_one_outlier_and_a_duplicate(raw):
    rows = _fare_rows([5000.0, 5100.0, 5200.0, 5300.0, 5400.0, 5500.0, 20000.0])
    copy = (99,) + rows[0][1:]
    result = cl.clean(raw(*rows, copy))
    status = {r.ingest_seq: r.quality_status for r in result.observations.collect()}
    assert len(status) == 8 and status[6] == "OUTLIER" and status[99] == "EXCLUDED"
    assert list(status.values()).count("VALID") == 6
    counts = cl.cleaning_counts(result).first()
    assert (counts.total_processed, counts.valid_count, counts.excluded_count, counts.outlier_count) == (8, 6, 1, 1)


def test_three_fares_are_too_few(raw):
    result = cl.clean(raw(*_fare_rows([10.0 + 300, 20.0 + 300, 90000.0])))
    assert {r.quality_status for r in result.observations.collect()} == {"VALID"}


def test_accepted_and_rejected_cover_the_input(raw):
    frame = raw(raw_row(1), raw_row(2, source="x"), raw_row(3, taxes=None), raw_row(4, flight_number="Z"))
    assert cl.accepted(frame).count() + cl.rejected(frame).count() == 4


@pytest.mark.parametrize(
    "value, expected",
    [("4500", 4500.0), (" ₹4,500 ", 4500.0), ("INR 12.5", 12.5), ("Rs. 7", 7.0), ("-500", -500.0), ("1_000", 1000.0), ("1e3", 1000.0),
     ("abc", None), ("", None), ("nan", None), ("inf", None), ("5d", None), (".5", 0.5), ("1e999", None)],
)
def test_fare_text(spark, value, expected):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(text.parse_fare(F.col("v"))).first()[0] == expected


def test_text_and_windows(spark):
    frame = spark.createDataFrame([("  a  b\t c ", " t_7 ", 30)], "v string, w string, d int")
    row = frame.select(text.normalize_text(F.col("v")), text.parse_window(F.col("w")), text.window_of_lead(F.col("d")), text.window_of_lead(F.lit(2))).first()
    assert tuple(row) == ("A B C", "T+7", "T+30", None)


def test_components_from_total(spark):
    frame = spark.createDataFrame([(5400.0, None, None, None), (100.0, 82.0, 15.0, 3.0), (100.0, 50.0, 15.0, 3.0), (0.01, None, None, None)],
                                  "t double, b double, x double, m double")
    rows = frame.select(*fares.split_total(F.col("t"), F.col("b"), F.col("x"), F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [(4428.0, 810.0, 162.0), (82.0, 15.0, 3.0), (82.0, 15.0, 3.0), (0.01, 0.0, 0.0)]


def test_status_text_and_contract(raw):
    row = cl.normalize(raw(raw_row(observation_status="weird", source="nope", base_fare=-4.0, total_fare=None))).withColumn(
        "v", cl.contract_violations()).withColumn("s", cl.classify_status_text(F.lit("weird"))).first()
    assert row.v == ["source: length", "base_fare: negative", "comparable_fare: not positive"]
    assert tuple(row.s) == ("SUSPECT", "WEIRD")


def test_pairing_fingerprint(spark):
    frame = spark.createDataFrame([("DEL-BOM", "T+7", "6E", "201", "06:30", "ECONOMY", "SAVER", "15KG", dt.date(2026, 1, 2))],
                                  "route string, booking_window string, airline string, flight_number string, departure_time string, "
                                  "cabin_class string, fare_type string, baggage_characteristics string, travel_date date")
    digest = hashlib.sha256(b"DEL-BOM|T+7|6E|201|06:30|ECONOMY|SAVER|15KG").hexdigest()[:16]
    assert frame.select(fingerprints.pairing_fingerprint()).first()[0] == f"DEL-BOM_T+7_{digest}"


@pytest.mark.parametrize("values", [[1, 2, 4, 8], [5], [1, 1, 1, 9], [-3.5, 0, 2, 2, 7.25, 1e9], list(range(101)), [0.001 * i for i in range(997)]])
def test_quantiles_match_linear_interpolation(spark, values):
    import numpy as np

    frame = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = exact_quantiles(frame, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert row.n_values == len(values)
    assert [row.a, row.b, row.c] == pytest.approx(list(np.percentile(values, [25, 50, 90])))


def test_quantiles_of_one_hot_value(spark):
    frame = spark.range(30000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    exact = frame.agg(F.percentile("v", F.lit(0.3))).first()[0]
    assert exact_quantiles(frame, ["g"], "v", {"p": 0.3}).first().p == pytest.approx(exact)
