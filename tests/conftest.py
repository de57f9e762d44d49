import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fareindex.schemas import OBSERVATIONS, RAW_QUOTES
from fareindex.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


DAY = dt.date(2026, 8, 20)


def raw_row(seq=1, **changes):
    row = dict(
        ingest_seq=seq, observation_timestamp=dt.datetime(2026, 8, 20, 10, 0), origin="DEL", destination="BOM", travel_date=DAY + dt.timedelta(days=7),
        observation_date=DAY, booking_window="T+7", airline="INDIGO", flight_number="6E123", departure_time="10:30", cabin_class="ECONOMY",
        fare_type="STANDARD", baggage_characteristics="15KG", base_fare=4500.0, taxes=700.0, mandatory_charges=100.0, total_fare=5300.0,
        source="TEST", observation_status=None, metadata={},
    )
    row.update(changes)
    return tuple(row.values())


@pytest.fixture
def raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RAW_QUOTES)


def obs_row(day, fare, flight="201", route="DEL-BOM", window="T+7", status="VALID", source="A"):
    lead = int(window[2:])
    return (
        route[:3], route[4:], day + dt.timedelta(days=lead), day, window, "6E", flight, "06:30", "ECONOMY", "SAVER", "15KG", float(fare), source,
        dt.datetime(day.year, day.month, day.day, 9), status, {},
    )


@pytest.fixture
def obs(spark):
    from pyspark.sql import functions as F

    def make(*rows):
        return spark.createDataFrame(list(rows), OBSERVATIONS).withColumn("route", F.concat_ws("-", "origin", "destination"))

    return make
