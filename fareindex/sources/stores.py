"""Stored tables: Parquet folders that only grow, keyed so that a repeated run adds nothing."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .. import constants as K
from ..functions.text import valid_route
from ..operators.cleaning import DUPLICATE_KEY, IDENTITY_TEXT, contract_violations
from ..operators.index import base_day_rows, one_version
from ..schemas import INDEX_RESULTS, ROUTE_INDICES, STORED_FARES

RESULT_KEY = ("observation_date", "booking_window", "calculation_version")
CPI_KEY = ("reference_date", "item_code", "base_year")
ROUTES_SCHEMA = "code string, origin string, destination string, active boolean"
CPI_SCHEMA = (
    "reference_date date, year int, month_name string, index_value double, item_code string, item string, base_year int, "
    "series string, state string, sector string, frequency string"
)


def written_yet(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, in whatever store the path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, empty when nothing has been written yet."""
    if written_yet(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)  # decimal and map columns included


def new_rows(df: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored, null being equal to null; the stored side brings its key columns only."""
    known = stored.select(*[F.col(c).alias(f"_k_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    return df.join(known, same, "left_anti")


def _write(df: DataFrame, path: str, partition_by: str | None, mode: str, options: dict[str, str]) -> int:
    """Write and return the number of rows, counted on the rows as they are written: nothing is counted before or after, and a task that is
    run again counts once, as the count stands behind the last shuffle."""
    seen = Observation()
    # Rebalancing gives each date its own files and splits a date that is much larger than the others.
    rows = df if partition_by is None else df.hint("rebalance", partition_by)
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**options)
    (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(path)
    return seen.get.get("rows") or 0


def _append(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    return _write(df, path, partition_by, "append", {})


def pruned_by(stored: DataFrame, batch: DataFrame, partition: str = "observation_date") -> DataFrame:
    """The rows of a partitioned table on the dates of a batch. The dates are sent to the scan while the query runs, which then reads only
    their folders; a batch has few dates, one for each calendar day."""
    # The comparison holds for every date; the planner prunes by a side only if that side is filtered.
    days = batch.select(F.col(partition).alias("_day")).filter(F.col("_day") >= F.lit("0001-01-01").cast("date")).distinct()
    return stored.join(F.broadcast(days), F.col(partition) == F.col("_day"), "left_semi")


def unique_observations(df: DataFrame) -> DataFrame:
    """One row per duplicate key, the earliest; copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in DUPLICATE_KEY]
    first = F.min_by(F.struct(*rest), "ingest_seq") if "ingest_seq" in rest else F.first(F.struct(*rest))
    return df.groupBy(*DUPLICATE_KEY).agg(first.alias("r")).select(*DUPLICATE_KEY, "r.*").select(*df.columns)


def storable_observations(normalized: DataFrame) -> DataFrame:
    """Normalized rows in the layout of the stored table, EXCLUDED rows left out."""
    money = {c: F.col(c).cast("decimal(12,2)") for c in ("base_fare", "taxes", "mandatory_charges", "comparable_fare")}
    return normalized.filter("quality_status <> 'EXCLUDED'").select(
        "route", "observation_timestamp", "observation_date", "travel_date", "booking_window", *IDENTITY_TEXT,
        *[v.alias(c) for c, v in money.items()], "source", "fingerprint", "quality_status",
        F.to_json("metadata").alias("metadata"),
    )


def without_timestamp(normalized: DataFrame) -> DataFrame:
    """Observations that the stored table refuses, with the reason: its contract asks for the time of observation."""
    return normalized.filter("quality_status <> 'EXCLUDED' AND observation_timestamp IS NULL").withColumn("quality_reason", F.lit(K.REASON_NO_TIMESTAMP))


def persist_observations(normalized: DataFrame, path: str, marked: bool = True, held: bool = False, tag: str | None = None) -> int:
    """Append the observations that are not stored yet; returns how many were added.

    ``marked`` states that later copies are EXCLUDED already, as the cleaning leaves them; otherwise the earliest copy of
    each key is taken here. Rows without a timestamp are left out (``without_timestamp`` gives them). The batch is computed once: its rows
    are held while their dates prune the scan of the stored table, unless the caller has ``held`` them or they come from files; a lost part
    is computed again. ``tag`` is stored with the rows as ``ingest_batch``, which readers of the plain layout do not see.
    """
    kept = normalized.filter("quality_status <> 'EXCLUDED' AND observation_timestamp IS NOT NULL")
    kept = kept if held else kept.persist(StorageLevel.DISK_ONLY)
    try:
        batch = storable_observations(kept if marked else unique_observations(kept))
        stored = pruned_by(read_table(normalized.sparkSession, path, STORED_FARES), kept)
        fresh = new_rows(batch, stored, DUPLICATE_KEY)
        return _append(fresh if tag is None else fresh.withColumn("ingest_batch", F.lit(tag)), path, "observation_date")
    finally:
        if not held:
            kept.unpersist()


def missing_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Valid route codes of the rows that the dimension does not hold."""
    code = valid_route(F.col("route"))
    found = df.select(code.alias("code")).filter("code is not null").distinct()
    return found.join(routes.select("code"), "code", "left_anti").select(
        "code", F.substring("code", 1, 3).alias("origin"), F.substring("code", 5, 3).alias("destination"), F.lit(True).alias("active")
    )


def upsert_routes(df: DataFrame, path: str) -> int:
    """Append the routes of the rows that the dimension does not hold; returns how many were added."""
    routes = read_table(df.sparkSession, path, ROUTES_SCHEMA)
    return _append(missing_routes(df, routes), path)


def conflicting_results(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results whose (date, window, version) is stored already."""
    return results.join(stored.select(*RESULT_KEY), list(RESULT_KEY), "left_semi")


def append_new(df: DataFrame, path: str, schema: str, key: Sequence[str], partition_by: str | None = "observation_date") -> int:
    """Append the rows whose key is not stored, so that a repeated write adds nothing; returns how many were added."""
    return _append(new_rows(df, read_table(df.sparkSession, path, schema), key), path, partition_by)


def refuse_known(results: DataFrame, results_path: str) -> None:
    """Stored history is immutable: a known version is an error."""
    stored = read_table(results.sparkSession, results_path, INDEX_RESULTS)
    if not conflicting_results(results, stored).isEmpty():
        raise ValueError("calculation version already exists; historical results are immutable")


def store_results(
    results: DataFrame, route_indices: DataFrame, results_path: str, routes_path: str, checked: bool = False
) -> tuple[int, int]:
    """Append one calculation; a known version is refused before anything is written, unless the caller has ``checked`` the keys.

    The results are written last and are the mark that a calculation is complete: after a failure in between, the next
    run adds what is missing, and ``readside.finished`` shows readers the routes of complete calculations only. Returns the rows added to
    the results and to the routes.
    """
    if not checked:
        refuse_known(results, results_path)
    routes = append_new(route_indices, routes_path, ROUTE_INDICES, (*RESULT_KEY, "route"))
    return _append(results, results_path, "observation_date"), routes


def result_rows(national: DataFrame, checksums: DataFrame, version: str, calculated_at) -> DataFrame:
    """National results in the stored layout; ``calculated_at`` is the timestamp column of the run."""
    return national.drop("weight_version").join(checksums, "observation_date").select(
        "observation_date", "booking_window", F.bround("national_index", 4).cast("decimal(12,4)").alias("index_value"), "status",
        "observation_set_version", "basket_version", "weight_version", "methodology_version",
        F.concat(F.lit("CALC_"), F.col("observation_date").cast("string"), F.lit("_" + version)).alias("calculation_version"),
        "execution_checksum", calculated_at.alias("calculation_timestamp"),
    )


def route_rows(grid: DataFrame, contributions: DataFrame, weights: DataFrame, version: str, calculated_at) -> DataFrame:
    """Route results in the stored layout: point contribution, else the level."""
    key = ["observation_date", "route", "booking_window"]
    found = contributions.select(*key, F.coalesce("point_contribution", "level_contribution").alias("contribution"))
    basket = one_version(weights).select("route", F.col("weight").alias("_w"))
    return grid.join(found, key, "left").join(basket, "route", "left").select(
        "observation_date", "booking_window",
        F.concat(F.lit("CALC_"), F.col("observation_date").cast("string"), F.lit("_" + version)).alias("calculation_version"),
        "route", F.bround("index_value", 4).cast("decimal(12,4)").alias("index_value"), "status",
        F.when(F.col("_w") != 0, F.bround("_w", 8)).cast("decimal(12,8)").alias("weight"),
        F.bround("contribution", 4).cast("decimal(12,4)").alias("contribution"),
        calculated_at.alias("calculation_timestamp"),
    )


def seed_base_day(
    weights: DataFrame, base_date, results_path: str, routes_path: str, calculated_at, observation_set: Column | None = None
) -> tuple[int, int]:
    """Store the base day; returns the rows added to the results and to the routes."""
    return store_results(*base_day_tables(weights, base_date, calculated_at, observation_set), results_path, routes_path)


def base_day_tables(weights: DataFrame, base_date, calculated_at, observation_set: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and route rows of the base day: index 100 for every window and basket route. ``observation_set`` names the quotes of a day that
    has some."""
    weights = one_version(weights)
    observation_set = F.lit("OBS_BASE") if observation_set is None else observation_set
    rows = base_day_rows(weights, base_date).withColumn("calculation_timestamp", calculated_at)
    results = rows.groupBy("observation_date", "booking_window", "calculation_version", "calculation_timestamp").agg(
        F.lit(K.BASE_INDEX).cast("decimal(12,4)").alias("index_value")
    ).select(
        "observation_date", "booking_window", "index_value", F.lit("SUCCESS").alias("status"), observation_set.alias("observation_set_version"),
        F.lit(K.BASKET_VERSION).alias("basket_version"), weights.agg(F.max("version")).scalar().alias("weight_version"),
        F.lit(K.METHODOLOGY_VERSION).alias("methodology_version"), "calculation_version", F.repeat(F.lit("0"), 64).alias("execution_checksum"),
        "calculation_timestamp",
    )
    return results, rows


def load_reference(series: DataFrame, path: str) -> int:
    """Append the reference months that are not stored yet; returns how many were added."""
    stored = read_table(series.sparkSession, path, CPI_SCHEMA)
    return _append(new_rows(series, stored, CPI_KEY).hint("rebalance"), path)


def append_checked(df: DataFrame, path: str) -> DataFrame:
    """Append the observations that keep the contract; returns the others with their violations."""
    checked = df.withColumn("violations", contract_violations())
    _append(storable_observations(checked.filter(F.size("violations") == 0)), path, "observation_date")
    return checked.filter(F.size("violations") > 0)


def append_rows(df: DataFrame, path: str, schema: str) -> None:
    """Append quality or event rows from upstream in the stored layout."""
    columns = read_table(df.sparkSession, path, schema).columns
    _append(df.select(*columns), path)


def replace_days(df: DataFrame, path: str) -> int:
    """Rewrite exactly the dates in the frame, for the rerun of a synthetic run; other dates stay. Returns the rows written."""
    return _write(df, path, "observation_date", "overwrite", {"partitionOverwriteMode": "dynamic"})
