"""Fixed values of the fare-index contract."""

# Advance-purchase windows (lead days) and their labels.
WINDOW_DAYS = (1, 7, 15, 30, 45)
WINDOWS = ("T+1", "T+7", "T+15", "T+30", "T+45")
HEADLINE_WINDOW = "T+15"

# Illustrative, unofficial demo basket.
DEMO_WEIGHT_VERSION = "DEMO_FIXTURE_TOP_ROUTES_V1"
DEMO_WEIGHT_SOURCE = "DEMO_FIXTURE"
DEMO_WEIGHTS = {
    "DEL-BOM": 0.25,
    "BOM-DEL": 0.25,
    "DEL-BLR": 0.15,
    "BLR-DEL": 0.15,
    "BOM-BLR": 0.10,
    "BLR-BOM": 0.10,
}

# Accepted source names and the canonical name of each.
SOURCE_ALIASES = {
    "INDIGO": "INDIGO",
    "INDIGO AIRLINES": "INDIGO",
    "6E": "INDIGO",
    "AIR INDIA": "AIR INDIA",
    "AIRINDIA": "AIR INDIA",
    "AI": "AIR INDIA",
    "AKASA": "AKASA AIR",
    "AKASA AIR": "AKASA AIR",
    "AKASA AIRLINES": "AKASA AIR",
    "QP": "AKASA AIR",
    "SPICEJET": "SPICEJET",
    "SPICE JET": "SPICEJET",
    "SG": "SPICEJET",
    "MAKEMYTRIP": "MAKEMYTRIP",
    "MAKE MY TRIP": "MAKEMYTRIP",
    "MAKE MYTRIP": "MAKEMYTRIP",
    "MMT": "MAKEMYTRIP",
    "YATRA": "YATRA",
    "YATRA.COM": "YATRA",
    "CLEARTRIP": "CLEARTRIP",
    "CLEAR TRIP": "CLEARTRIP",
    "IXIGO": "IXIGO",
    "IXIGO.COM": "IXIGO",
    "TEST": "TEST",
    "MOCK": "MOCK",
    "DEMO": "MOCK",
    "IGNAV": "IGNAV",
}

# Quality statuses and status texts.
QUALITY_STATUSES = ("VALID", "SUSPECT", "EXCLUDED", "OUTLIER")
CANCELLED_TEXT = "CANCELLED"
SOLD_OUT_TEXTS = ("SOLD OUT", "SOLD_OUT")
UNAVAILABLE_TEXT = "UNAVAILABLE"
AVAILABLE_TEXTS = ("", "AVAILABLE", "VALID", "NORMAL")

# Reason texts written to rejected and excluded rows.
REASON_CANCELLED = "cancelled flight: CANCELLED"
REASON_SOLD_OUT = "sold-out observation: SOLD_OUT"
REASON_UNAVAILABLE = "unavailable observation: UNAVAILABLE"
REASON_NO_ORIGIN = "missing origin"
REASON_NO_DESTINATION = "missing destination"
REASON_NO_TRAVEL_DATE = "missing travel date: MISSING_TRAVEL_DATE"
REASON_TRAVEL_BEFORE = "travel date is before observation date"
REASON_NO_SOURCE = "missing source: MISSING_SOURCE"
REASON_UNKNOWN_SOURCE = "UNKNOWN_SOURCE"
REASON_NO_AIRLINE = "missing airline"
REASON_NO_BASE = "missing base fare: MISSING_FARE"
REASON_BAD_BASE = "negative base fare"
REASON_NO_TAXES = "missing taxes"
REASON_BAD_TAXES = "invalid taxes"
REASON_NO_CHARGES = "missing mandatory charges"
REASON_BAD_CHARGES = "invalid mandatory charges"
REASON_BAD_TOTAL = "invalid total fare"
REASON_MISSING_FARE = "MISSING_FARE"
REASON_INVALID_FARE = "INVALID_FARE"
REASON_SAME_CITY = "Origin and destination cannot be the same"
REASON_DUPLICATE = "exact duplicate observation"
REASON_NO_TIMESTAMP = "missing observation timestamp"
REASON_OUTLIER = "comparable fare flagged as an IQR outlier"

# Component shares used when only a total is known.
BASE_SHARE, TAX_SHARE = 0.82, 0.15
COMPONENT_TOLERANCE = 0.05

# Index calculation.
BASE_INDEX = 100.0
COVERAGE_TOLERANCE = 1e-4
MIN_COVERAGE = 0.5
METHODOLOGY_VERSION = "JEVONS_SHORT_INDEX_v1.0"
BASKET_VERSION = "BASKET_v1.0"

# Thresholds of the rule-based signals.
ANOMALY_LEVELS = {"LOW": 2.0, "MEDIUM": 5.0, "HIGH": 10.0}
SHOCK_LEVELS = {"LOW": 5.0, "MEDIUM": 10.0, "HIGH": 20.0}
PRESSURE_WEIGHTS = {
    "movement": 0.35,
    "acceleration": 0.15,
    "anomaly": 0.15,
    "agreement": 0.15,
    "route_coverage": 0.10,
    "source_coverage": 0.05,
    "lead_time": 0.05,
    "demand_availability": 0.00,
}
CONFIDENCE_WEIGHTS = {
    "coverage": 0.25,
    "source_coverage": 0.10,
    "observation_volume": 0.15,
    "agreement": 0.20,
    "data_quality": 0.15,
    "freshness": 0.10,
    "anomaly": 0.05,
}
MODEL_VERSION = "intelligence-rules-v1"
FEATURE_VERSION = "features-v1"

# National airfare slice of the CPI sheet.
CPI_FILTER = {
    "series": "Current",
    "state": "All India",
    "sector": "Combined",
    "division": "Transport",
    "group": "Passenger transport services",
    "class": "Passenger transport by air",
    "sub_class": "Passenger transport by air, domestic",
    "item": "Airfare",
    "code": "07.3.3.1.2.01",
}
CPI_BASE_YEAR = 2024
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)

# Explanations of the validation metrics.
METRIC_TEXTS = {
    "Pearson Correlation (r)": "Linear co-movement across aligned calendar months (minimum 3 months required)",
    "Spearman Rank Correlation (rho)": "Monotonic ranking consistency across aligned monthly index shifts",
    "Absolute Level Difference": "Absolute divergence between project monthly index and MoSPI benchmark level at reference month",
    "Mean Absolute Error (MAE)": "Average absolute divergence across all aligned calendar months",
    "Percentage Difference": "Relative percentage difference against official MoSPI benchmark level",
    "Corridor Coverage": "Proportion of representative basket corridors successfully computed",
    "Index Stability": "Standard deviation of daily percentage changes in official index",
}
