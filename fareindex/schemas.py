"""Explicit table schemas as DDL text; nothing is inferred on read."""

_IDENTITY = (
    "airline string, flight_number string, departure_time string, cabin_class string, "
    "fare_type string, baggage_characteristics string"
)

RAW_QUOTES = (
    "ingest_seq bigint, observation_timestamp timestamp, origin string, destination string, "
    f"travel_date date, observation_date date, booking_window string, {_IDENTITY}, "
    "base_fare double, taxes double, mandatory_charges double, total_fare double, "
    "source string, observation_status string, metadata map<string,string>"
)

RAW_QUOTES_TEXT = RAW_QUOTES.replace("double", "string")

OBSERVATIONS = (
    f"origin string, destination string, travel_date date, observation_date date, booking_window string, {_IDENTITY}, "
    "comparable_fare double, source string, observation_timestamp timestamp, quality_status string, "
    "metadata map<string,string>"
)

STORED_FARES = (
    f"route string, observation_timestamp timestamp, observation_date date, travel_date date, booking_window string, "
    f"{_IDENTITY}, base_fare decimal(12,2), taxes decimal(12,2), mandatory_charges decimal(12,2), "
    "comparable_fare decimal(12,2), source string, fingerprint string, quality_status string, metadata string"
)

WEIGHTS = (
    "route string, weight double, version string, source string, effective_from date, is_official boolean, ordinal int"
)

INDEX_RESULTS = (
    "observation_date date, booking_window string, index_value decimal(12,4), status string, "
    "observation_set_version string, basket_version string, weight_version string, methodology_version string, "
    "calculation_version string, execution_checksum string, calculation_timestamp timestamp"
)

ROUTE_INDICES = (
    "observation_date date, booking_window string, calculation_version string, route string, "
    "index_value decimal(12,4), status string, weight decimal(12,8), contribution decimal(12,4), "
    "calculation_timestamp timestamp"
)

QUALITY_METRICS = (
    "metric_date date, route string, source string, observation_count bigint, route_coverage decimal(6,4), "
    "source_coverage decimal(6,4), freshness_minutes int, missing_observations bigint, invalid_observations bigint, "
    "anomalous_valid_observations bigint, status string, generated_at timestamp"
)

CPI_SHEET = (
    "base_year int, series string, year int, month string, state string, sector string, division string, "
    "`group` string, `class` string, sub_class string, item string, code string, `index` string, inflation double, "
    "imputation string"
)

ITINERARY = (
    "ignav_id string, cabin_class string, requires_self_transfer boolean, bags string, "
    "price struct<amount:double,currency:string,status:string>, "
    "outbound struct<carrier:string,duration_minutes:int,segments:array<struct<departure_time_local:string,"
    "flight_number:string,operating_carrier_name:string,marketing_carrier_code:string,departure_timezone:string,"
    "arrival_airport:string,arrival_time_local:string,aircraft:string>>>"
)
