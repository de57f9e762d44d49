"""Fare tables derived from the supplied event and order tables.

The supplied tables hold no fares. A user stands for one flight product, an event for one quote of it; the mapping is the
same expression in Spark and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.text import canonical_source, evaluate_once, normalize_text

ROUTES = tuple(K.DEMO_WEIGHTS)
# Fixed values of the mapping: airline of a product, source text of an event type.
AIRLINES = ("IndiGo", "Air India", "Akasa Air")
EVENT_SOURCES = {"view": "mmt", "click": " Yatra.com ", "purchase": "Clear  Trip", "signup": "IXIGO", "error": "test"}


def pick(index: Column, values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_quotes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Raw quotes: every event, none dropped."""
    user = F.col("user_id")
    route = pick(user % 6, ROUTES)
    lead = pick(F.floor(user / 6) % 5, K.WINDOW_DAYS)
    ts = F.col("ts").cast("timestamp")
    source = F.lit(None).cast("string")
    for event_type, text in EVENT_SOURCES.items():
        source = F.when(F.col("event_type") == event_type, text).otherwise(source)
    events = table(spark, sf_dir, "events") if events is None else events
    return evaluate_once(
        events,
        F.col("event_id").alias("ingest_seq"),
        ts.alias("observation_timestamp"),
        F.substring(route, 1, 3).alias("origin"),
        F.substring(route, 5, 3).alias("destination"),
        F.date_add(F.to_date(ts), lead).alias("travel_date"),
        F.to_date(ts).alias("observation_date"),
        F.concat(F.lit("T+"), lead.cast("string")).alias("booking_window"),
        pick(user % 3, AIRLINES).alias("airline"),
        F.concat(F.lit("f "), user.cast("string")).alias("flight_number"),
        F.concat(F.lpad((user % 24).cast("string"), 2, "0"), F.lit(":30")).alias("departure_time"),
        F.lit("economy").alias("cabin_class"),
        pick(user % 2, ("Saver", "Regular")).alias("fare_type"),
        F.lit("15kg").alias("baggage_characteristics"),
        (F.col("value") * 0.82).alias("base_fare"),
        (F.col("value") * 0.15).alias("taxes"),
        (F.col("value") * 0.03).alias("mandatory_charges"),
        F.col("value").alias("total_fare"),
        source.alias("source"),
        F.lit(None).cast("string").alias("observation_status"),
        F.create_map(F.lit("event"), F.col("event_type")).alias("metadata"),
    )


def flawed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes with defects placed by event number, so that every cleaning rule has work to do.

    A tenth of the quotes is repeated exactly under a later sequence number.
    """
    raw = raw_quotes(spark, sf_dir)
    again = F.col("ingest_seq") + 1000000000
    numbers = F.when(F.col("ingest_seq") % 10 == 3, F.array("ingest_seq", again)).otherwise(F.array("ingest_seq"))
    raw = raw.withColumn("ingest_seq", F.explode(numbers))
    n = F.col("ingest_seq") % 97

    def change(name, cases):
        value = F.col(name)
        for slot, new in cases.items():
            value = F.when(n == slot, new).otherwise(value)
        return value

    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    changed = raw.withColumns(
        {
            "observation_status": change(
                "observation_status",
                {1: F.lit("cancelled"), 2: F.lit("Sold  out"), 3: F.lit("sold_out"), 4: F.lit("unavailable"), 5: F.lit("odd")},
            ),
            "origin": change("origin", {6: none_text, 7: F.lit("  ")}),
            "destination": change("destination", {8: none_text, 9: F.col("origin")}),
            "travel_date": change(
                "travel_date",
                {10: F.lit(None).cast("date"), 11: F.date_sub("observation_date", 2), 12: F.date_add("observation_date", 3)},
            ),
            "source": change("source", {13: none_text, 14: F.lit("somewhere")}),
            "airline": change("airline", {15: F.lit(" ")}),
            "base_fare": change("base_fare", {16: none_num, 17: -F.col("base_fare"), 18: F.lit(float("nan"))}),
            "taxes": change("taxes", {19: none_num, 20: F.lit(0.0)}),
            "mandatory_charges": change("mandatory_charges", {21: none_num, 22: F.lit(float("inf"))}),
            "total_fare": change("total_fare", {23: F.lit(-1.0), 24: none_num}),
            "observation_date": change("observation_date", {25: F.lit(None).cast("date")}),
        }
    )
    return evaluate_once(changed, *changed.columns)


LANDING_GROUP = 8 << 20  # bytes of a row group


def land(quotes: DataFrame, path: str, files: int) -> None:
    """Write the quotes as so many files for a stream. A file is split between row groups only, so groups below the default size let the few
    files of a batch be read by more tasks than there are files."""
    quotes.repartition(files, "ingest_seq").write.option("parquet.block.size", LANDING_GROUP).parquet(path)


def index_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as clean index observations: positive fare, status VALID."""
    raw = raw_quotes(spark, sf_dir)
    tidy = ("airline", "flight_number", "departure_time", "cabin_class", "fare_type", "baggage_characteristics")
    return raw.select(
        "ingest_seq", "origin", "destination", F.concat_ws("-", "origin", "destination").alias("route"),
        "travel_date", "observation_date", "booking_window", *[normalize_text(F.col(c)).alias(c) for c in tidy],
        (F.col("base_fare") + F.col("taxes") + F.col("mandatory_charges")).alias("comparable_fare"),
        canonical_source(F.col("source")).alias("source"), "observation_timestamp",
        F.lit("VALID").alias("quality_status"), "metadata",
    ).filter("comparable_fare > 0")


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily index table from the orders: mean order price per day and priority, priorities as windows."""
    window = pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, K.WINDOWS)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("observation_date"), window.alias("booking_window"))
        .agg((F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1)) / 2500.0).alias("index_value"))
    )


def ship_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second daily index from the shipped lines, used as the reference series."""
    window = pick(F.col("l_linenumber") % 5, K.WINDOWS)
    price = F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("observation_date"), window.alias("booking_window"))
        .agg((price / 500.0).alias("index_value"))
    )


def cpi_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet in the layout of the official CPI export, from monthly line prices; synthetic, never official."""
    month = F.trunc(F.to_date("l_shipdate"), "month")
    price = F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(month.alias("m"), F.col("l_returnflag").alias("flag"))
        .agg(F.round(price / 400.0, 2).alias("v"))
    )
    airfare = F.col("flag") == "A"
    fixed = {k: F.lit(v) for k, v in K.CPI_FILTER.items()}
    fixed["item"] = F.when(airfare, " Airfare ").when(F.col("flag") == "N", "AIRFARE").otherwise("Rail fare")
    fixed["state"] = F.when(F.col("flag") == "N", "Goa").otherwise("All India")
    return monthly.select(
        F.lit(K.CPI_BASE_YEAR).alias("base_year"), fixed["series"].alias("series"), F.year("m").alias("year"),
        F.date_format("m", "MMMM").alias("month"), fixed["state"].alias("state"), fixed["sector"].alias("sector"),
        fixed["division"].alias("division"), fixed["group"].alias("group"), fixed["class"].alias("class"),
        fixed["sub_class"].alias("sub_class"), fixed["item"].alias("item"), fixed["code"].alias("code"),
        F.col("v").cast("string").alias("index"), F.lit(None).cast("double").alias("inflation"),
        F.lit("No").alias("imputation"),
    )
