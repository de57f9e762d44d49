"""Table expressions of the checking SQL, mirroring the derived tables."""

from .. import constants as K
from ..sources.testdata import AIRLINES, EVENT_SOURCES, ROUTES
from .registry import cte


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def norm(expr: str) -> str:
    return f"upper(trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g')))"


def finite(expr: str) -> str:
    return f"CASE WHEN isfinite({expr}) THEN {expr} END"


TEXTS = ("airline", "flight_number", "departure_time", "cabin_class", "fare_type", "baggage_characteristics")
WINDOW_VALUES = ", ".join(f"('{w}', {d})" for w, d in zip(K.WINDOWS, K.WINDOW_DAYS))
SOURCE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SOURCES.items()) + " END"

cte("windows", f"SELECT * FROM (VALUES {WINDOW_VALUES}) t(booking_window, lead)")
cte("aliases", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in K.SOURCE_ALIASES.items()) + ") t(alias, canonical)")
cte("demo", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', CAST({w} AS DOUBLE), {i})" for i, (r, w) in enumerate(K.DEMO_WEIGHTS.items())) + ") t(route, weight, ordinal)")
# A basket with one route that is never observed and without one that is.
cte("wide", "SELECT * FROM (VALUES ('DEL-BOM', 0.29::DOUBLE, 0), ('BOM-DEL', 0.22::DOUBLE, 1), ('DEL-BLR', 0.14::DOUBLE, 2), "
            "('BLR-DEL', 0.12::DOUBLE, 3), ('BOM-BLR', 0.06::DOUBLE, 4), ('DEL-GOI', 0.17::DOUBLE, 5)) t(route, weight, ordinal)")

cte("raw", f"""
SELECT event_id AS ingest_seq, ts AS observation_timestamp, substr(rt, 1, 3) AS origin, substr(rt, 5, 3) AS destination,
  CAST(ts AS DATE) + ld AS travel_date, CAST(ts AS DATE) AS observation_date, 'T+' || ld AS booking_window,
  ({listed(AIRLINES)})[1 + user_id % 3] AS airline, 'f ' || user_id AS flight_number,
  lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || ':30' AS departure_time, 'economy' AS cabin_class,
  (['Saver', 'Regular'])[1 + user_id % 2] AS fare_type, '15kg' AS baggage_characteristics,
  value * 0.82::DOUBLE AS base_fare, value * 0.15::DOUBLE AS taxes, value * 0.03::DOUBLE AS mandatory_charges,
  value AS total_fare, {SOURCE_CASE} AS source, CAST(NULL AS VARCHAR) AS observation_status, event_type, user_id
FROM (SELECT *, ({listed(ROUTES)})[1 + user_id % 6] AS rt, ({listed(K.WINDOW_DAYS)})[CAST(1 + (user_id // 6) % 5 AS INT)] AS ld FROM events)
""")
cte("copied", """
SELECT * FROM raw UNION ALL SELECT * REPLACE (ingest_seq + 1000000000 AS ingest_seq) FROM raw WHERE ingest_seq % 10 = 3
""")
cte("flawed", """
SELECT * REPLACE (
  CASE n WHEN 1 THEN 'cancelled' WHEN 2 THEN 'Sold  out' WHEN 3 THEN 'sold_out' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'odd' END AS observation_status,
  CASE n WHEN 6 THEN NULL WHEN 7 THEN '  ' ELSE origin END AS origin,
  CASE n WHEN 8 THEN NULL WHEN 9 THEN origin ELSE destination END AS destination,
  CASE n WHEN 10 THEN NULL WHEN 11 THEN observation_date - 2 WHEN 12 THEN observation_date + 3 ELSE travel_date END AS travel_date,
  CASE n WHEN 13 THEN NULL WHEN 14 THEN 'somewhere' ELSE source END AS source,
  CASE n WHEN 15 THEN ' ' ELSE airline END AS airline,
  CASE n WHEN 16 THEN NULL WHEN 17 THEN -base_fare WHEN 18 THEN 'nan'::DOUBLE ELSE base_fare END AS base_fare,
  CASE n WHEN 19 THEN NULL WHEN 20 THEN 0.0 ELSE taxes END AS taxes,
  CASE n WHEN 21 THEN NULL WHEN 22 THEN 'inf'::DOUBLE ELSE mandatory_charges END AS mandatory_charges,
  CASE n WHEN 23 THEN -1.0 WHEN 24 THEN NULL ELSE total_fare END AS total_fare,
  CASE n WHEN 25 THEN NULL ELSE observation_date END AS observation_date)
FROM (SELECT *, ingest_seq % 97 AS n FROM copied)
""")
cte("tidied", f"""
SELECT f.*, {norm('origin')} AS o, {norm('destination')} AS d, {', '.join(f'{norm(c)} AS n_{c}' for c in TEXTS)},
  {norm('source')} AS src, {norm('observation_status')} AS st,
  coalesce(observation_date, CAST(observation_timestamp AS DATE)) AS day,
  travel_date - coalesce(observation_date, CAST(observation_timestamp AS DATE)) AS lead_days,
  {finite('base_fare')} AS b, {finite('taxes')} AS t, {finite('mandatory_charges')} AS m, {finite('total_fare')} AS tot
FROM flawed f
""")


def bad(c: str) -> str:
    return f"NOT coalesce({c} > 0, FALSE)"


RAW_REASON = f"""CASE WHEN st = 'CANCELLED' THEN '{K.REASON_CANCELLED}' WHEN st IN ('SOLD OUT', 'SOLD_OUT') THEN '{K.REASON_SOLD_OUT}'
  WHEN st = 'UNAVAILABLE' THEN '{K.REASON_UNAVAILABLE}' WHEN o = '' THEN 'missing origin' WHEN d = '' THEN 'missing destination'
  WHEN travel_date IS NULL THEN '{K.REASON_NO_TRAVEL_DATE}' WHEN lead_days < 0 THEN '{K.REASON_TRAVEL_BEFORE}'
  WHEN src = '' THEN '{K.REASON_NO_SOURCE}' WHEN src NOT IN (SELECT alias FROM aliases) THEN '{K.REASON_UNKNOWN_SOURCE}'
  WHEN n_airline = '' THEN 'missing airline' WHEN base_fare IS NULL THEN '{K.REASON_NO_BASE}' WHEN {bad('b')} THEN '{K.REASON_BAD_BASE}'
  WHEN taxes IS NULL THEN 'missing taxes' WHEN {bad('t')} THEN 'invalid taxes'
  WHEN mandatory_charges IS NULL THEN 'missing mandatory charges' WHEN {bad('m')} THEN 'invalid mandatory charges'
  WHEN total_fare IS NOT NULL AND {bad('tot')} THEN 'invalid total fare' END"""
LEAD_ERROR = ("'Lead time of ' || lead_days || ' days does not match a supported booking window. "
              "Expected one of: T+1, T+7, T+15, T+30, T+45.'")
NORMALIZE_ERROR = f"""CASE WHEN travel_date IS NULL THEN 'Travel date is required' WHEN o = '' THEN 'Origin is required'
  WHEN d = '' THEN 'Destination is required' WHEN o = d THEN '{K.REASON_SAME_CITY}'
  WHEN src NOT IN (SELECT alias FROM aliases) THEN 'unknown source: ' || coalesce(source, 'None')
  WHEN lead_days NOT IN (1, 7, 15, 30, 45) THEN {LEAD_ERROR} END"""
FARE = "CASE WHEN b > 0 AND t > 0 AND m > 0 THEN b + t + m WHEN tot > 0 THEN tot END"
EXCLUDED_REASON = (f"CASE WHEN st IN ('CANCELLED', 'SOLD OUT', 'SOLD_OUT', 'UNAVAILABLE') THEN st WHEN ({FARE}) IS NULL THEN 'MISSING_FARE' END")

cte("assessed", f"""
SELECT x.*, {RAW_REASON} AS raw_reason, {NORMALIZE_ERROR} AS normalize_error, {EXCLUDED_REASON} AS excluded_reason, {FARE} AS fare,
  (SELECT canonical FROM aliases WHERE alias = src) AS canonical, (SELECT booking_window FROM windows w WHERE w.lead = lead_days) AS win,
  sha256(concat_ws('|', o, d, coalesce(CAST(travel_date AS VARCHAR), ''), n_flight_number, n_departure_time, n_cabin_class, n_fare_type, n_baggage_characteristics)) AS fingerprint
FROM tidied x
""")
cte("accepted", """
SELECT *, o || '-' || d AS route, row_number() OVER (PARTITION BY fingerprint, observation_timestamp, canonical ORDER BY ingest_seq) AS copy_no
FROM assessed WHERE raw_reason IS NULL AND normalize_error IS NULL AND excluded_reason IS NULL
""")
cte("bounds", """
SELECT day, count(*) AS n_values, quantile_cont(fare, 0.25) AS q1, quantile_cont(fare, 0.75) AS q3,
  quantile_cont(fare, 0.25) - 1.5 * (quantile_cont(fare, 0.75) - quantile_cont(fare, 0.25)) AS lower_bound,
  quantile_cont(fare, 0.75) + 1.5 * (quantile_cont(fare, 0.75) - quantile_cont(fare, 0.25)) AS upper_bound
FROM accepted WHERE copy_no = 1 GROUP BY day HAVING count(*) >= 4
""")
cte("cleaned", f"""
SELECT a.*, CASE WHEN copy_no > 1 THEN 'EXCLUDED' WHEN fare < lower_bound OR fare > upper_bound THEN 'OUTLIER' ELSE 'VALID' END AS quality_status,
  CASE WHEN copy_no > 1 THEN '{K.REASON_DUPLICATE}' WHEN fare < lower_bound OR fare > upper_bound THEN '{K.REASON_OUTLIER}' ELSE '' END AS quality_reason
FROM accepted a LEFT JOIN bounds USING (day)
""")

# ------------------------------------------------------------------ index
cte("obs", f"""
SELECT ingest_seq, observation_timestamp, origin, destination, origin || '-' || destination AS route, travel_date, observation_date, booking_window,
  {', '.join(f'{norm(c)} AS {c}' for c in TEXTS)}, base_fare + taxes + mandatory_charges AS comparable_fare,
  (SELECT canonical FROM aliases WHERE alias = {norm('raw.source')}) AS source
FROM raw WHERE base_fare + taxes + mandatory_charges > 0
""")
cte("priced", f"""
SELECT *, route || '_' || booking_window || '_' || substr(sha256(concat_ws('|', route, booking_window, {', '.join(TEXTS)})), 1, 16) AS fingerprint FROM obs
""")
cte("best", "SELECT observation_date, route, booking_window, fingerprint, min(comparable_fare) AS fare, count(*) AS quotes FROM priced GROUP BY ALL")
cte("pairs", """
SELECT c.observation_date, c.route, c.booking_window, c.fingerprint, c.fare AS current_fare, p.fare AS previous_fare, c.fare / p.fare AS relative
FROM best c JOIN best p ON p.observation_date = c.observation_date - 1 AND p.fingerprint = c.fingerprint
""")
cte("tdates", "SELECT DISTINCT observation_date FROM obs WHERE observation_date - 1 IN (SELECT observation_date FROM obs)")
cte("elem", "SELECT observation_date, route, booking_window, exp(avg(ln(relative))) AS gm, count(*) AS n FROM pairs GROUP BY ALL")
cte("sizes", "SELECT observation_date, route, booking_window, count(*) AS n FROM obs GROUP BY ALL")
cte("seen", """
SELECT DISTINCT t.observation_date, s.route FROM tdates t JOIN sizes s ON s.observation_date IN (t.observation_date, t.observation_date - 1)
""")
cte("grid0", """
SELECT s.observation_date, s.route, w.booking_window, e.gm AS geometric_mean, e.gm * 100 AS index_value, coalesce(e.n, 0) AS num_matched_pairs,
  coalesce(c.n, 0) AS num_current_observations, coalesce(p.n, 0) AS num_previous_observations,
  CASE WHEN e.n >= 1 THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status
FROM seen s CROSS JOIN windows w
LEFT JOIN elem e ON e.observation_date = s.observation_date AND e.route = s.route AND e.booking_window = w.booking_window
LEFT JOIN sizes c ON c.observation_date = s.observation_date AND c.route = s.route AND c.booking_window = w.booking_window
LEFT JOIN sizes p ON p.observation_date = s.observation_date - 1 AND p.route = s.route AND p.booking_window = w.booking_window
""")
cte("grid", """
SELECT g.*, max(status) OVER (PARTITION BY g.observation_date, g.route) AS route_status, y.index_value AS previous_index
FROM grid0 g LEFT JOIN (SELECT observation_date + 1 AS observation_date, route, booking_window, index_value FROM grid0) y USING (observation_date, route, booking_window)
""")


def national(name: str, grid: str, basket: str, partial: bool, threshold: float = 0.5) -> None:
    """National index and contributions of a grid, as tables name_cov, name and name_contrib."""
    cte(f"{name}_w", f"""
SELECT g.observation_date, g.route, g.booking_window, g.index_value, g.previous_index, coalesce(w.weight, 0) AS weight
FROM {grid} g LEFT JOIN {basket} w USING (route) WHERE g.status = 'SUCCESS'
""")
    cte(f"{name}_cov", f"""
SELECT k.observation_date, k.booking_window, round(least(1, greatest(0, coalesce(sum(x.weight), 0))), 12) AS coverage_ratio,
  coalesce(list(x.route ORDER BY w.ordinal) FILTER (w.route IS NOT NULL), []) AS present_routes,
  (SELECT list(b.route ORDER BY b.ordinal) FROM {basket} b) AS basket_routes,
  sum(x.weight * x.index_value) AS full_sum,
  sum(x.weight * x.index_value) FILTER (x.weight > 0) / nullif(sum(x.weight) FILTER (x.weight > 0), 0) AS part_sum
FROM (SELECT DISTINCT observation_date, booking_window FROM {grid}) k
LEFT JOIN {name}_w x USING (observation_date, booking_window) LEFT JOIN {basket} w ON w.route = x.route GROUP BY k.observation_date, k.booking_window
""")
    strict = "FALSE" if partial else "coverage_ratio < 1 - 1e-4"
    pct = "printf('%.2f', coverage_ratio * 100) || '%'"
    miss = "list_filter(basket_routes, lambda r: NOT list_contains(present_routes, r))"
    listed_miss = f"'[' || array_to_string(list_transform({miss}, lambda r: '''' || r || ''''), ', ') || ']'"
    cte(name, f"""
SELECT observation_date, booking_window, coverage_ratio,
  CASE WHEN coverage_ratio = 0 OR {strict} OR coverage_ratio < {threshold} THEN NULL WHEN coverage_ratio < 1 - 1e-4 THEN part_sum ELSE full_sum END AS national_index,
  CASE WHEN coverage_ratio = 0 OR {strict} OR coverage_ratio < {threshold} THEN 'INSUFFICIENT_DATA' WHEN coverage_ratio < 1 - 1e-4 THEN 'PARTIAL_COVERAGE' ELSE 'SUCCESS' END AS status,
  {miss} AS missing_routes, present_routes,
  concat_ws(',', CASE WHEN len({miss}) > 0 THEN 'Missing route data for weighted routes: ' || {listed_miss} || '. Coverage: ' || {pct} END,
    CASE WHEN coverage_ratio = 0 THEN 'No observed routes match the weight configuration basket'
      WHEN {strict} THEN 'Incomplete route basket under strict authoritative coverage (allow_partial_coverage=False). Missing weighted routes: ' || {listed_miss} || '. Coverage: ' || {pct}
      WHEN coverage_ratio < {threshold} THEN 'Coverage ' || {pct} || ' is below threshold {threshold * 100:.2f}%' END) AS warnings
FROM {name}_cov
""")
    cte(f"{name}_eff", f"""
SELECT x.observation_date, x.route, x.booking_window, x.index_value, x.previous_index,
  CASE WHEN n.status = 'SUCCESS' THEN x.weight
    ELSE coalesce((CASE WHEN x.weight > 0 THEN x.weight ELSE 0 END) / nullif(sum(CASE WHEN x.weight > 0 THEN x.weight ELSE 0 END) OVER (PARTITION BY x.observation_date, x.booking_window), 0), 0) END AS weight
FROM {name}_w x JOIN {name} n USING (observation_date, booking_window) WHERE n.status IN ('SUCCESS', 'PARTIAL_COVERAGE')
""")
    cte(f"{name}_contrib", f"""
SELECT *, weight * index_value AS level_contribution, weight * (index_value - previous_index) AS point_contribution,
  CASE WHEN abs(sum(weight * (index_value - previous_index)) OVER g) > 1e-6
    THEN weight * (index_value - previous_index) / sum(weight * (index_value - previous_index)) OVER g * 100 END AS percentage_share_of_change
FROM {name}_eff WINDOW g AS (PARTITION BY observation_date, booking_window)
""")


national("nat", "grid", "demo", True)
national("nats", "grid", "wide", False)
national("natw", "grid", "wide", True)

# ------------------------------------------------------- stored result tables
cte("runs", "SELECT * FROM (VALUES ('A', 1, 1.0::DOUBLE), ('B', 2, 1.01::DOUBLE)) t(version, hours, factor)")
cte("results", """
SELECT n.observation_date, n.booking_window, round_even(n.national_index * r.factor, 4) AS index_value, n.status,
  'CALC_' || CAST(n.observation_date AS VARCHAR) || '_' || r.version AS calculation_version,
  CAST(n.observation_date AS TIMESTAMP) + to_hours(r.hours) AS calculation_timestamp
FROM nat n JOIN runs r ON r.version = 'A' OR day(n.observation_date) % 3 = 0
""")
cte("route_results", """
SELECT g.observation_date, g.booking_window, 'CALC_' || CAST(g.observation_date AS VARCHAR) || '_' || r.version AS calculation_version, g.route,
  round_even(g.index_value * r.factor, 4) AS index_value, g.status, w.weight,
  round_even(coalesce(c.point_contribution, c.level_contribution), 4) AS contribution,
  CAST(g.observation_date AS TIMESTAMP) + to_hours(r.hours) AS calculation_timestamp
FROM grid g JOIN runs r ON r.version = 'A' OR day(g.observation_date) % 3 = 0
LEFT JOIN nat_contrib c ON c.observation_date = g.observation_date AND c.route = g.route AND c.booking_window = g.booking_window
LEFT JOIN demo w ON w.route = g.route
""")
cte("latest", """
SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY observation_date, booking_window ORDER BY calculation_timestamp DESC) = 1
""")
cte("latest_routes", """
SELECT * FROM route_results QUALIFY row_number() OVER (PARTITION BY observation_date, booking_window, route ORDER BY calculation_timestamp DESC) = 1
""")

# ------------------------------------------------------------------- signals
cte("anomaly", """
SELECT *, CASE WHEN previous_index <> 0 THEN index_value - previous_index END AS point_change,
  CASE WHEN previous_index <> 0 THEN (index_value - previous_index) / previous_index * 100 END AS percentage_change,
  CASE WHEN previous_index <> 0 THEN abs((index_value - previous_index) / previous_index * 100) END AS anomaly_score,
  coalesce(CASE WHEN previous_index <> 0 THEN CASE WHEN abs((index_value - previous_index) / previous_index * 100) >= 10 THEN 'HIGH'
    WHEN abs((index_value - previous_index) / previous_index * 100) >= 5 THEN 'MEDIUM'
    WHEN abs((index_value - previous_index) / previous_index * 100) >= 2 THEN 'LOW' END END, 'NORMAL') AS severity
FROM grid WHERE index_value IS NOT NULL
""")
cte("explained", """
SELECT *, severity <> 'NORMAL' AS detected, CASE WHEN severity <> 'NORMAL' THEN route || ' (' || booking_window || ') airfare index '
    || CASE WHEN percentage_change > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || printf('%.2f', anomaly_score) || '% from '
    || printf('%.2f', previous_index) || ' to ' || printf('%.2f', index_value) || '. Severity: ' || severity || '.'
  WHEN previous_index IS NULL THEN 'Insufficient data for anomaly detection.' END AS reason
FROM anomaly
""")
cte("smeans", "SELECT observation_date, route, booking_window, source, avg(comparable_fare) AS average_fare, count(*) AS quotes FROM obs GROUP BY ALL")
cte("smoves", """
SELECT c.observation_date, c.route, c.booking_window, c.source, p.average_fare AS previous_fare, c.average_fare AS current_fare,
  (c.average_fare - p.average_fare) / p.average_fare * 100 AS percentage_change,
  CASE WHEN abs((c.average_fare - p.average_fare) / p.average_fare * 100) <= 0.5 THEN 'STABLE' WHEN c.average_fare > p.average_fare THEN 'UPWARD' ELSE 'DOWNWARD' END AS direction
FROM smeans c JOIN smeans p ON p.observation_date = c.observation_date - 1 AND p.route = c.route AND p.booking_window = c.booking_window AND p.source = c.source
""")
cte("confirm0", """
SELECT observation_date, route, booking_window, list(source ORDER BY source) AS sources, count(*) AS n,
  count(*) FILTER (direction = 'UPWARD') AS up, count(*) FILTER (direction = 'DOWNWARD') AS down, count(*) FILTER (direction = 'STABLE') AS flat,
  coalesce(list(source ORDER BY source) FILTER (direction = 'UPWARD'), []) AS up_s, coalesce(list(source ORDER BY source) FILTER (direction = 'DOWNWARD'), []) AS down_s,
  coalesce(list(source ORDER BY source) FILTER (direction = 'STABLE'), []) AS flat_s
FROM smoves GROUP BY ALL
""")
cte("confirm1", """
SELECT *, CASE WHEN n >= 2 THEN CASE WHEN up >= down AND up >= flat THEN 'UPWARD' WHEN down >= flat THEN 'DOWNWARD' ELSE 'STABLE' END END AS direction FROM confirm0
""")
cte("confirm2", """
SELECT *, CASE direction WHEN 'UPWARD' THEN up_s WHEN 'DOWNWARD' THEN down_s WHEN 'STABLE' THEN flat_s ELSE [] END AS agreeing_sources,
  CASE direction WHEN 'UPWARD' THEN up WHEN 'DOWNWARD' THEN down WHEN 'STABLE' THEN flat END AS agree FROM confirm1
""")
cte("confirmed", """
SELECT *, agree / n AS agreement_ratio, coalesce(agree >= 2 AND agree / n >= 0.5 AND direction <> 'STABLE', FALSE) AS confirmed FROM confirm2
""")

# -------------------------------------------------------------- long series
cte("orderidx", f"""
SELECT CAST(o_orderdate AS DATE) AS observation_date, ({listed(K.WINDOWS)})[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS booking_window,
  CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) / count(*) / 2500.0 AS index_value FROM orders GROUP BY 1, 2
""")
cte("shipidx", f"""
SELECT CAST(l_shipdate AS DATE) AS observation_date, ({listed(K.WINDOWS)})[1 + l_linenumber % 5] AS booking_window,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) / count(*) / 500.0 AS index_value FROM lineitem GROUP BY 1, 2
""")
cte("sheet", f"""
SELECT 2024 AS base_year, CAST(year(m) AS INT) AS "year", monthname(m) AS "month", CASE WHEN flag = 'N' THEN 'Goa' ELSE 'All India' END AS "state",
  CASE flag WHEN 'A' THEN ' Airfare ' WHEN 'N' THEN 'AIRFARE' ELSE 'Rail fare' END AS item, v, m
FROM (SELECT date_trunc('month', CAST(l_shipdate AS DATE)) AS m, l_returnflag AS flag,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) / count(*) / 400.0, 2) AS v FROM lineitem GROUP BY 1, 2)
""")
cte("cpi", "SELECT CAST(m AS DATE) AS reference_date, v AS index_value, \"year\", \"month\" FROM sheet WHERE item = ' Airfare ' AND \"state\" = 'All India'")
