"""Registered queries: scalar functions, classification, cleaning, duplicates, outliers, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import fares, fingerprints as fp, text
from ..operators import cleaning as cl, index as ix
from ..operators.quantiles import exact_quantiles
from ..session import work_dir
from ..sources import cpi, quotes, testdata as td
from . import frames as fr
from .registry import D, R, TS, cents, query
from .tables import FARE, TEXTS, bad, norm

FARE_TEXT_SQL = """CASE event_id % 9 WHEN 0 THEN 'INR ' || value WHEN 1 THEN '₹' || value WHEN 2 THEN 'Rs. ' || value WHEN 3 THEN '  1,' || value || ' '
  WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN '-' || value WHEN 7 THEN 'NaN' ELSE CAST(value AS VARCHAR) END"""


def _fare_texts(spark, sf):
    v = F.col("value").cast("string")
    cases = {0: F.concat(F.lit("INR "), v), 1: F.concat(F.lit("₹"), v), 2: F.concat(F.lit("Rs. "), v), 3: F.concat(F.lit("  1,"), v, F.lit(" ")),
             4: F.lit("abc"), 5: F.lit(""), 6: F.concat(F.lit("-"), v), 7: F.lit("NaN")}
    t = v
    for slot, new in cases.items():
        t = F.when(F.col("event_id") % 9 == slot, new).otherwise(t)
    return td.table(spark, sf, "events").select("event_id", "value", t.alias("fare_text"))


NUMBER_SQL = """CASE event_id % 9 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN value WHEN 3 THEN CAST('1' || value AS DOUBLE)
  WHEN 6 THEN -value WHEN 8 THEN value END"""


@query("p1_normalize_text", f"SELECT ingest_seq, {norm('raw.source')} AS source_text, {norm('airline')} AS airline_text FROM raw")
def _(spark, sf):
    return td.raw_quotes(spark, sf).select(
        "ingest_seq", text.normalize_text(F.col("source")).alias("source_text"), text.normalize_text(F.col("airline")).alias("airline_text")
    )


@query("p2_canonical_source", "SELECT canonical AS source, count(*) AS quotes FROM tidied LEFT JOIN aliases ON alias = src GROUP BY 1")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).groupBy(text.canonical_source(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("quotes"))


@query("p3_parse_fare_text", f"SELECT event_id, {R(NUMBER_SQL, 'fare')} FROM events")
def _(spark, sf):
    return _fare_texts(spark, sf).select("event_id", text.parse_fare(F.col("fare_text")).alias("fare"))


@query("p4_comparable_fare", f"SELECT ingest_seq, {R(FARE, 'comparable_fare')} FROM tidied")
def _(spark, sf):
    return cl.tidy(td.flawed_quotes(spark, sf)).select(
        "ingest_seq", fares.comparable_fare(*[F.col(c) for c in ("base_fare", "taxes", "mandatory_charges", "total_fare")]).alias("comparable_fare")
    )


@query("p5_observation_day", f"SELECT ingest_seq, {D('day', 'observation_date')} FROM tidied")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).select("ingest_seq", cl.observation_day().alias("observation_date"))


@query("p6_lead_days_and_window", "SELECT ingest_seq, CAST(lead_days AS INT) AS lead_days, w.booking_window FROM tidied LEFT JOIN windows w ON w.lead = lead_days")
def _(spark, sf):
    lead = cl.lead_days(cl.observation_day(), F.col("travel_date"))
    return td.flawed_quotes(spark, sf).select("ingest_seq", lead.alias("lead_days"), text.window_of_lead(lead).alias("booking_window"))


@query("p7_parse_window", """SELECT ingest_seq, CASE WHEN ingest_seq % 5 = 4 THEN NULL ELSE raw.booking_window END AS booking_window, CASE WHEN ingest_seq % 5 <> 4 THEN lead END AS lead_days
FROM raw JOIN windows USING (booking_window)""")
def _(spark, sf):
    n, w = F.col("ingest_seq") % 5, F.col("booking_window")
    messy = (
        F.when(n == 0, F.lower(w)).when(n == 1, F.concat(F.lit("  T_"), F.substring(w, 3, 2), F.lit(" ")))
        .when(n == 2, F.concat(F.lit("T + "), F.substring(w, 3, 2))).when(n == 4, F.lit("T+99")).otherwise(w)
    )
    window = text.parse_window(messy)
    return td.raw_quotes(spark, sf).select("ingest_seq", window.alias("booking_window"), text.lead_of_window(window).alias("lead_days"))


@query("p8_travel_date", f"SELECT ingest_seq, {D('CASE WHEN ingest_seq % 7 <> 0 THEN observation_date + lead END', 'travel_date')} FROM raw JOIN windows USING (booking_window)")
def _(spark, sf):
    lead = F.when(F.col("ingest_seq") % 7 == 0, 8).otherwise(text.lead_of_window(F.col("booking_window")))
    return td.raw_quotes(spark, sf).select("ingest_seq", text.travel_date(F.col("observation_date"), lead).alias("travel_date"))


@query("p9_identity_fingerprint", "SELECT ingest_seq, fingerprint FROM assessed")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).select("ingest_seq", fp.identity_fingerprint().alias("fingerprint"))


@query("p10_pairing_fingerprint", f"""SELECT ingest_seq, fingerprint, route || '_' || booking_window || '_' || substr(sha256(concat_ws('|', route, booking_window,
  {', '.join(TEXTS)}, CAST(travel_date AS VARCHAR))), 1, 16) AS dated_fingerprint FROM priced""")
def _(spark, sf):
    return td.index_observations(spark, sf).select(
        "ingest_seq", fp.pairing_fingerprint().alias("fingerprint"), fp.pairing_fingerprint(True).alias("dated_fingerprint")
    )


@query("p11_normalize_quotes", f"""SELECT ingest_seq, o AS origin, d AS destination, CAST(lead_days AS INT) AS lead_days, win AS booking_window, n_airline AS airline,
  {R('fare', 'comparable_fare')}, canonical AS source, fingerprint, CASE WHEN excluded_reason IS NULL THEN 'VALID' ELSE 'EXCLUDED' END AS quality_status,
  coalesce(excluded_reason, '') AS quality_reason, normalize_error,
  'canonical_source=' || coalesce(canonical, '') || ',event=' || event_type || ',lead_days=' || coalesce(CAST(lead_days AS VARCHAR), '') || ',observation_status=' || st || ',quality_reason_code=' || coalesce(excluded_reason, '') AS metadata
FROM assessed""")
def _(spark, sf):
    return cl.normalize(td.flawed_quotes(spark, sf)).select(
        "ingest_seq", "origin", "destination", "lead_days", "booking_window", "airline", "comparable_fare", "source", "fingerprint",
        "quality_status", "quality_reason", "normalize_error", "metadata",
    )


@query("p12_index_ready_rows", f"SELECT route, {D('day', 'observation_date')}, win AS booking_window, {R('fare', 'comparable_fare')}, quality_status, {TS('observation_timestamp')} FROM cleaned")
def _(spark, sf):
    return cl.to_index_observations(fr.cleaned(spark, sf).observations).select(
        "route", "observation_date", "booking_window", "comparable_fare", "quality_status", "observation_timestamp"
    )


@query("p13_build_observations", f"""SELECT upper(trim(airline)) AS airline, origin || '-' || destination AS route, booking_window, {R('total_fare', 'comparable_fare')}, {TS('observation_timestamp')}
FROM flawed WHERE coalesce(trim(origin), '') <> '' AND coalesce(trim(destination), '') <> '' AND origin <> destination AND total_fare > 0 AND travel_date IS NOT NULL AND observation_date IS NOT NULL AND travel_date >= observation_date""")
def _(spark, sf):
    raw = td.flawed_quotes(spark, sf).withColumn("comparable_fare", F.col("total_fare")).withColumn("quality_status", F.lit("valid"))
    return cl.build_observations(raw).select("airline", "route", "booking_window", "comparable_fare", "observation_timestamp")


@query("p14_valid_route", """SELECT ingest_seq, CASE WHEN regexp_full_match(upper(r), '[A-Z]{3}-[A-Z]{3}') AND substr(upper(r), 1, 3) <> substr(upper(r), 5, 3) THEN upper(r) END AS route
FROM (SELECT ingest_seq, CASE ingest_seq % 4 WHEN 0 THEN lower(origin) || '-' || destination WHEN 1 THEN origin || '-' || origin WHEN 2 THEN origin || destination ELSE origin || '-' || destination END AS r FROM raw)""")
def _(spark, sf):
    n, o, d = F.col("ingest_seq") % 4, F.col("origin"), F.col("destination")
    code = F.when(n == 0, F.concat(F.lower(o), F.lit("-"), d)).when(n == 1, F.concat(o, F.lit("-"), o)).when(n == 2, F.concat(o, d)).otherwise(F.concat(o, F.lit("-"), d))
    return td.raw_quotes(spark, sf).select("ingest_seq", text.valid_route(code).alias("route"))


@query("p15_index_change", f"""SELECT {D('observation_date')}, route, booking_window, {R('index_value - previous_index', 'point_change')}, {R('(index_value - previous_index) / previous_index * 100', 'percentage_change')}
FROM grid WHERE previous_index IS NOT NULL AND index_value IS NOT NULL""")
def _(spark, sf):
    point, percent = ix.index_change(F.col("index_value"), F.col("previous_index"))
    return fr.history(spark, sf).grid.filter("index_value is not null and previous_index is not null").select(
        "observation_date", "route", "booking_window", point.alias("point_change"), percent.alias("percentage_change")
    )


@query("p16_to_number", f"SELECT event_id, {R('CASE WHEN event_id % 9 = 6 THEN -value WHEN event_id % 9 = 8 THEN value END', 'number')} FROM events")
def _(spark, sf):
    return _fare_texts(spark, sf).select("event_id", text.to_number(F.col("fare_text")).alias("number"))


CHECKSUM_SQL = f"""
SELECT {D('n.observation_date', 'observation_date')}, 'OBS_' || CAST(n.observation_date AS VARCHAR) AS observation_set_version,
  sha256('{{"basket_version":"{K.BASKET_VERSION}","curr_obs_count":"' || c.cur || '","methodology_version":"{K.METHODOLOGY_VERSION}","national_indices":"' || n.idx
    || '","obs_date":"' || CAST(n.observation_date AS VARCHAR) || '","obs_version":"OBS_' || CAST(n.observation_date AS VARCHAR) || '","prev_date":"'
    || CAST(n.observation_date - 1 AS VARCHAR) || '","prev_obs_count":"' || c.prev || '","routes_count":"' || c.routes || '","weight_version":"{K.DEMO_WEIGHT_VERSION}"}}') AS execution_checksum
FROM (SELECT observation_date, string_agg(booking_window || '=' || CASE WHEN national_index IS NULL THEN 'null' ELSE printf('%.6f', national_index) END, ',' ORDER BY booking_window) AS idx FROM nat GROUP BY 1) n
JOIN (SELECT observation_date, CAST(sum(num_current_observations) AS BIGINT) AS cur, CAST(sum(num_previous_observations) AS BIGINT) AS prev, count(DISTINCT route) AS routes FROM grid GROUP BY 1) c USING (observation_date)"""


@query("p17_execution_checksum", CHECKSUM_SQL)
def _(spark, sf):
    return fr.history(spark, sf).checksums().select("observation_date", "observation_set_version", "execution_checksum")


# ------------------------------------------------------------ classification


@query("c1_classify_raw", "SELECT ingest_seq, CASE WHEN raw_reason IS NULL THEN 'VALID' ELSE 'EXCLUDED' END AS raw_status, coalesce(raw_reason, '') AS raw_reason FROM assessed")
def _(spark, sf):
    return cl.classify(td.flawed_quotes(spark, sf)).select("ingest_seq", "raw_status", "raw_reason")


@query("c2_positive_fare", f"SELECT event_id, coalesce(({NUMBER_SQL}) > 0, FALSE) AS is_fare FROM events")
def _(spark, sf):
    from pyspark.sql.types import StringType

    return _fare_texts(spark, sf).select("event_id", cl.is_positive_fare(F.col("fare_text"), StringType()).alias("is_fare"))


@query("c3_known_source", "SELECT ingest_seq, src IN (SELECT alias FROM aliases) AS known FROM tidied")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).select("ingest_seq", text.is_known_source(F.col("source")).alias("known"))


@query("c4_status_text", f"""SELECT ingest_seq, CASE WHEN st IN ('CANCELLED', 'SOLD OUT', 'SOLD_OUT', 'UNAVAILABLE') THEN 'EXCLUDED' WHEN st IN ('', 'AVAILABLE', 'VALID', 'NORMAL') THEN 'VALID' ELSE 'SUSPECT' END AS status,
  CASE WHEN st = 'CANCELLED' THEN '{K.REASON_CANCELLED}' WHEN st IN ('SOLD OUT', 'SOLD_OUT') THEN '{K.REASON_SOLD_OUT}' WHEN st = 'UNAVAILABLE' THEN '{K.REASON_UNAVAILABLE}' WHEN st IN ('', 'AVAILABLE', 'VALID', 'NORMAL') THEN '' ELSE st END AS reason FROM tidied""")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).select("ingest_seq", cl.classify_status_text(F.col("observation_status")).alias("s")).select("ingest_seq", "s.*")


@query("c5_required_fields", "SELECT ingest_seq, CASE WHEN o = '' THEN 'missing origin' WHEN d = '' THEN 'missing destination' WHEN travel_date IS NULL THEN 'missing travel date' WHEN src = '' THEN 'missing source' END AS missing FROM tidied")
def _(spark, sf):
    return td.flawed_quotes(spark, sf).select("ingest_seq", cl.missing_required_field().alias("missing"))


@query("c6_row_contract", f"""SELECT ingest_seq, CASE WHEN o = '' THEN 'missing origin' WHEN d = '' THEN 'missing destination' WHEN o = d THEN 'invalid route' WHEN travel_date IS NULL THEN 'missing travel date'
    WHEN travel_date < day THEN 'travel date before observation date' WHEN canonical IS NULL THEN 'missing source' WHEN fare IS NULL THEN '{K.REASON_NO_BASE}' END AS row_error,
  concat_ws(',', CASE WHEN o = '' THEN 'origin: length' END, CASE WHEN d = '' THEN 'destination: length' END, CASE WHEN n_airline = '' THEN 'airline: length' END,
    CASE WHEN canonical IS NULL THEN 'source: length' END, CASE WHEN b < 0 THEN 'base_fare: negative' END, CASE WHEN fare IS NULL THEN 'comparable_fare: not positive' END,
    CASE WHEN win IS NULL THEN 'booking_window: unknown' END) AS violations FROM assessed""")
def _(spark, sf):
    rows = cl.normalize(td.flawed_quotes(spark, sf))
    return rows.select("ingest_seq", cl.normalized_row_error().alias("row_error"), cl.contract_violations().alias("violations"))


@query("c7_rejected_quotes", """SELECT ingest_seq, coalesce(raw_reason, normalize_error, excluded_reason) AS reject_reason,
  'event=' || event_type || ',quality_reason=' || coalesce(raw_reason, normalize_error, excluded_reason) || ',quality_status=EXCLUDED' AS metadata
FROM assessed WHERE coalesce(raw_reason, normalize_error, excluded_reason) IS NOT NULL""")
def _(spark, sf):
    return cl.rejected(td.flawed_quotes(spark, sf)).select("ingest_seq", "reject_reason", "metadata")


@query("c8_validate_weights", """SELECT version, routes, round(total, 6) + 0.0 AS total_weight, CASE WHEN abs(total - 1) > 1e-4 THEN 'Weights do not sum to 1.0 (actual sum: ' || printf('%.6f', total) || ')' ELSE '' END AS errors, abs(total - 1) <= 1e-4 AS is_valid
FROM (SELECT observation_date::VARCHAR AS version, count(*) AS routes, sum(w) AS total FROM (SELECT observation_date, route, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY observation_date), 2) AS w FROM obs GROUP BY 1, 2) GROUP BY 1)""")
def _(spark, sf):
    return ix.validate_weights(_traffic_weights(spark, sf, 2))


def _traffic_weights(spark, sf, places=None):
    """Shares of the quotes per route and day, one weight version per day."""
    from pyspark.sql import Window

    n = td.index_observations(spark, sf).groupBy("observation_date", "route").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("observation_date"))
    return n.select(
        "route", (F.col("n").cast("double") if places is None else F.round(share, places)).alias("weight"),
        F.col("observation_date").cast("string").alias("version"), F.lit("HISTORICAL_PASSENGER_TRAFFIC").alias("source"),
    )


@query("c9_build_weights", f"SELECT version, route, {R('n * 1.0 / sum(n) OVER (PARTITION BY version)', 'weight')} FROM (SELECT observation_date::VARCHAR AS version, route, count(*) AS n FROM obs GROUP BY 1, 2)")
def _(spark, sf):
    return ix.build_weights(_traffic_weights(spark, sf), auto_normalize=True).select("version", "route", "weight")


@query("c10_read_filters", f"SELECT {D('observation_date')}, booking_window, {R('index_value')}, calculation_version FROM results WHERE observation_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND booking_window = 'T+7'")
def _(spark, sf):
    from ..operators.readside import read_filter

    return read_filter(fr.results(spark, sf), "2024-01-05", "2024-01-20", "T+7").select("observation_date", "booking_window", "index_value", "calculation_version")


# -------------------------------------------------------------- data quality


@query("d1_mark_duplicates", f"""SELECT ingest_seq, CASE WHEN copy_no > 1 THEN 'EXCLUDED' ELSE 'VALID' END AS quality_status, CASE WHEN copy_no > 1 THEN '{K.REASON_DUPLICATE}' ELSE '' END AS quality_reason FROM accepted""")
def _(spark, sf):
    return cl.mark_duplicates(cl.accepted(td.flawed_quotes(spark, sf))).select("ingest_seq", "quality_status", "quality_reason")


@query("d2_find_duplicates", "SELECT ingest_seq, route FROM accepted WHERE copy_no > 1")
def _(spark, sf):
    return cl.find_duplicates(cl.accepted(td.flawed_quotes(spark, sf))).select("ingest_seq", "route")


@query("d2_count_duplicates", "SELECT route, CAST(sum(CASE WHEN copy_no > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM accepted GROUP BY 1")
def _(spark, sf):
    return cl.count_duplicates(cl.accepted(td.flawed_quotes(spark, sf)), "route")


@query("d3_iqr_bounds", f"SELECT {D('day', 'observation_date')}, n_values, {R('q1')}, {R('q3')}, {R('lower_bound')}, {R('upper_bound')} FROM bounds")
def _(spark, sf):
    good = cl.accepted(td.flawed_quotes(spark, sf))
    return cl.iqr_bounds(cl.kept_fares(good))


@query("d3_quantiles_by_route", f"SELECT route, count(*) AS n_values, {R('quantile_cont(comparable_fare, 0.1)', 'p10')}, {R('quantile_cont(comparable_fare, 0.5)', 'p50')}, {R('quantile_cont(comparable_fare, 0.99)', 'p99')} FROM obs GROUP BY route")
def _(spark, sf):
    return exact_quantiles(td.index_observations(spark, sf), ["route"], "comparable_fare", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query("d4_mark_outliers", "SELECT ingest_seq, quality_status, quality_reason FROM cleaned WHERE quality_status <> 'EXCLUDED'")
def _(spark, sf):
    good = cl.accepted(td.flawed_quotes(spark, sf))
    return cl.mark_outliers(cl.mark_duplicates(good), bounds=cl.iqr_bounds(cl.kept_fares(good))).filter("quality_status <> 'EXCLUDED'").select("ingest_seq", "quality_status", "quality_reason")


@query("d5_clean_quotes", f"SELECT ingest_seq, route, {D('day', 'observation_date')}, win AS booking_window, {R('fare', 'comparable_fare')}, canonical AS source, fingerprint, quality_status, quality_reason FROM cleaned")
def _(spark, sf):
    return cl.split_assessed(fr.assessed(spark, sf)).observations.select(
        "ingest_seq", "route", "observation_date", "booking_window", "comparable_fare", "source", "fingerprint", "quality_status", "quality_reason"
    )


@query("d6_cleaning_counts", f"""SELECT {D('observation_date')}, CAST(sum(total) AS BIGINT) AS total_processed, CAST(sum(v) AS BIGINT) AS valid_count, CAST(sum(e) AS BIGINT) AS excluded_count, CAST(sum(x) AS BIGINT) AS outlier_count
FROM (SELECT day AS observation_date, 1 AS total, CAST(quality_status = 'VALID' AS INT) AS v, CAST(quality_status = 'EXCLUDED' AS INT) AS e, CAST(quality_status = 'OUTLIER' AS INT) AS x FROM cleaned
  UNION ALL SELECT day, 1, 0, 1, 0 FROM assessed WHERE coalesce(raw_reason, normalize_error, excluded_reason) IS NOT NULL) GROUP BY observation_date""")
def _(spark, sf):
    return cl.assessed_counts(fr.assessed(spark, sf))


@query("d13_index_ready", f"SELECT route, {D('day', 'observation_date')}, win AS booking_window, {R('fare', 'comparable_fare')}, canonical AS source, {TS('observation_timestamp')} FROM cleaned WHERE quality_status = 'VALID'")
def _(spark, sf):
    return cl.index_ready(td.flawed_quotes(spark, sf)).select("route", "observation_date", "booking_window", "comparable_fare", "source", "observation_timestamp")


# ------------------------------------------------------------------- sources

@query("s1_complete_raw", f"""SELECT ingest_seq, {R(f'CASE WHEN ingest_seq % 3 = 0 AND total_fare > 0 THEN {cents("total_fare * 0.82")} ELSE base_fare END', 'base_fare')},
  {R(f'CASE WHEN ingest_seq % 3 = 0 AND total_fare > 0 THEN {cents("total_fare * 0.15")} ELSE taxes END', 'taxes')},
  sha256(concat_ws('|', origin || '-' || destination, CAST(travel_date AS VARCHAR), airline, flight_number, departure_time, booking_window, raw.source, strftime(observation_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00')) AS observation_id FROM raw""")
def _(spark, sf):
    some = F.when(F.col("ingest_seq") % 3 != 0, F.col("base_fare"))
    rows = quotes.complete_raw(td.raw_quotes(spark, sf).withColumn("base_fare", some))
    return rows.select("ingest_seq", "base_fare", "taxes", "observation_id")


@query("s2_flatten_itineraries", f"""SELECT ingest_seq, 'UNKNOWN' AS fare_type, flight_number, departure_time, CASE WHEN ingest_seq % 4 = 0 THEN 'UNKNOWN' ELSE 'ECONOMY' END AS cabin_class,
  CASE WHEN ingest_seq % 2 = 0 THEN 'NOT_SPECIFIED' ELSE '{{"checked":1}}' END AS baggage_characteristics, {R('total_fare')}, 'INR' AS currency, airline, ingest_seq || ' false None' AS metadata
FROM raw WHERE ingest_seq % 11 <> 0 AND ingest_seq % 13 <> 0""")
def _(spark, sf):
    n = F.col("ingest_seq")
    departs = F.when(n % 13 == 0, F.lit("soon")).otherwise(F.concat(F.col("travel_date").cast("string"), F.lit("T"), F.col("departure_time"), F.lit(":00")))
    segment = F.struct(departs.alias("departure_time_local"), "flight_number")
    body = F.to_json(
        F.struct(
            n.cast("string").alias("ignav_id"), F.when(n % 4 != 0, "economy").alias("cabin_class"),
            F.when(n % 2 == 0, F.lit("{}")).otherwise(F.lit('{"checked":1}')).alias("bags"),
            F.struct(F.col("total_fare").alias("amount")).alias("price"),
            F.struct(F.col("airline").alias("carrier"), F.when(n % 11 != 0, F.array(segment)).otherwise(F.array().cast(
                "array<struct<departure_time_local:string,flight_number:string>>")).alias("segments")).alias("outbound"),
        )
    )
    raw = td.raw_quotes(spark, sf).select("ingest_seq", "origin", "destination", "travel_date", "observation_date", body.alias("itinerary"))
    return quotes.flatten_itineraries(raw).select(
        "ingest_seq", "fare_type", "flight_number", "departure_time", "cabin_class", "baggage_characteristics", "total_fare", "currency", "airline",
        F.concat_ws(" ", *[F.col("metadata")[k] for k in ("ignav_id", "requires_self_transfer", "price_status")]).alias("metadata"),
    )


@query("s3_search_grid", f"SELECT route, {D('observation_date')}, CAST(lead AS INT) AS lead_days, {D('observation_date + lead', 'travel_date')} FROM (SELECT DISTINCT route, observation_date FROM obs) CROSS JOIN windows")
def _(spark, sf):
    pairs = td.index_observations(spark, sf).select("route", "observation_date").distinct()
    return quotes.search_grid(pairs, F.col("observation_date"))


@query("s4_directed_routes", "SELECT a.c AS origin, b.c AS destination, a.c || '-' || b.c AS route FROM (SELECT DISTINCT origin AS c FROM raw) a JOIN (SELECT DISTINCT origin AS c FROM raw) b ON a.c <> b.c")
def _(spark, sf):
    return quotes.directed_routes(td.raw_quotes(spark, sf).select(F.col("origin").alias("city")))


@query("s5_sheet_scan", f"SELECT trim(item) AS item, count(*) AS n, CAST(sum(\"year\") AS BIGINT) AS years, {R('sum(v)', 'total')} FROM sheet GROUP BY 1")
def _(spark, sf):
    path = work_dir(spark, "sheet")
    td.cpi_sheet(spark, sf).write.option("header", "true").csv(path)
    rows = cpi.read_sheet(spark, path)
    return rows.groupBy(F.trim("item").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("year").cast("long").alias("years"), F.sum(F.col("index").cast("double")).alias("total"))


@query("s6_airfare_slice", f"SELECT \"year\", \"month\", \"state\", {R('v', 'index_number')} FROM sheet WHERE lower(trim(item)) = 'airfare'")
def _(spark, sf):
    return cpi.airfare_slice(td.cpi_sheet(spark, sf)).select("year", "month", "state", F.col("index").cast("double").alias("index_number"))


@query("s7_latest_airfare", f"SELECT \"year\", \"month\", \"state\", {R('v', 'index_number')} FROM sheet WHERE lower(trim(item)) = 'airfare' ORDER BY m DESC, \"state\" LIMIT 1")
def _(spark, sf):
    return cpi.latest_airfare(td.cpi_sheet(spark, sf)).select("year", "month", "state", F.col("index").cast("double").alias("index_number"))


@query("s8_national_series", f"SELECT {D('reference_date')}, \"year\", \"month\" AS month_name, {R('index_value')}, '07.3.3.1.2.01' AS item_code, 2024 AS base_year FROM cpi")
def _(spark, sf):
    return cpi.national_series(td.cpi_sheet(spark, sf)).select("reference_date", "year", "month_name", "index_value", "item_code", "base_year")


@query("s10_deserialize_observations", f"""SELECT route, {D('observation_date')}, booking_window, {R('total_fare', 'comparable_fare')}, {TS('observation_timestamp')}, 'VALID' AS quality_status
FROM (SELECT *, origin || '-' || destination AS route FROM raw) WHERE ingest_seq % 17 <> 0 AND ingest_seq % 19 <> 0 AND total_fare > 0""")
def _(spark, sf):
    n = F.col("ingest_seq")
    raw = td.raw_quotes(spark, sf)
    texts = raw.select(
        "origin", "destination", F.col("travel_date").cast("string").alias("travel_date"),
        F.when(n % 17 == 0, "not a date").otherwise(F.col("observation_date").cast("string")).alias("observation_date"),
        F.lower("booking_window").alias("booking_window"), "airline", "flight_number", "departure_time", "cabin_class", "fare_type",
        F.lit(None).cast("string").alias("baggage_characteristics"),
        F.when(n % 19 == 0, "n/a").otherwise(F.col("total_fare").cast("string")).alias("comparable_fare"), "source",
        F.col("observation_timestamp").cast("string").alias("observation_timestamp"), F.lit(None).cast("string").alias("quality_status"), "metadata",
    )
    return quotes.deserialize_observations(texts).select("route", "observation_date", "booking_window", "comparable_fare", "observation_timestamp", "quality_status")


@query("i3_bridge_records", f"""SELECT ingest_seq, {D('observation_date')}, booking_window, departure_time,
  {R(f'CASE WHEN ingest_seq % 3 = 0 AND total_fare > 0 THEN {cents("total_fare * 0.82")} ELSE base_fare END', 'base_fare')} FROM raw""")
def _(spark, sf):
    n = F.col("ingest_seq")
    raw = td.raw_quotes(spark, sf)
    records = raw.withColumns(
        {
            "observation_date": F.when(n % 5 != 0, F.col("observation_date")),
            "booking_window": F.substring("booking_window", 3, 2),
            "departure_time": F.concat("departure_time", F.lit(":00")),
            "base_fare": F.when(n % 3 != 0, F.col("base_fare")),
        }
    )
    return quotes.bridge_records(records).select("ingest_seq", "observation_date", "booking_window", "departure_time", "base_fare")
