"""The external monthly price index, read from the exported sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import constants as K
from ..functions.text import literal_map, to_number
from ..schemas import CPI_SHEET

# Columns the sheet must have.
REQUIRED = (
    "base_year", "series", "year", "month", "state", "sector", "division", "group", "class", "sub_class", "item", "code",
    "index", "inflation", "imputation",
)


def check_columns(sheet: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in sheet.columns]
    if missing:
        raise ValueError(f"price index sheet is missing expected columns: {missing}")
    return sheet


def read_sheet(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """The exported sheet; a CSV is read with its header and the fixed schema."""
    if file_format == "csv":
        header = spark.read.option("header", "true").csv(path)
        check_columns(header)
        return header.select(*[F.col(f"`{c}`") for c in REQUIRED]).withColumns(
            {"base_year": F.col("base_year").cast("int"), "year": F.col("year").cast("int"), "inflation": F.col("inflation").try_cast("double")}
        )
    return check_columns(spark.read.schema(CPI_SHEET).format(file_format).load(path))


def airfare_slice(sheet: DataFrame) -> DataFrame:
    return sheet.filter(F.lower(F.trim("item")) == "airfare")


def month_number(month: Column) -> Column:
    """1-12 for a month name in any case, null otherwise."""
    names = {name.lower(): i + 1 for i, name in enumerate(K.MONTH_NAMES)}
    return literal_map(names)[F.lower(F.trim(month))]


def latest_airfare(sheet: DataFrame) -> DataFrame:
    """The airfare row of the latest month, by month number."""
    return airfare_slice(sheet).orderBy(F.desc("year"), F.desc(month_number(F.col("month"))), "state").limit(1)


def _national(sheet: DataFrame) -> DataFrame:
    keep = F.col("base_year") == K.CPI_BASE_YEAR
    for column, value in K.CPI_FILTER.items():
        keep = keep & (F.trim(F.col(f"`{column}`")) == value)
    return check_columns(sheet).filter(keep)


def national_series(sheet: DataFrame) -> DataFrame:
    """The national airfare series, checked: readable month and index, positive, one row per month, not empty."""
    number = month_number(F.col("month"))
    value = to_number(F.col("index"))
    rows = _national(sheet).withColumn("reference_date", F.make_date("year", number, F.lit(1))).withColumn("_v", value)
    copies = F.count(F.lit(1)).over(Window.partitionBy("reference_date"))
    shown = F.coalesce(F.col("reference_date").cast("string"), F.lit("?"))
    error = (
        F.when(F.col("reference_date").isNull(), F.concat(F.lit("Unrecognized month format "), F.coalesce("month", F.lit("?"))))
        .when(F.col("_copies") > 1, F.concat(F.lit("Duplicate monthly observation detected for "), shown))
        .when(F.col("_v").isNull(), F.concat(F.lit("Invalid non-numeric index value on "), shown))
        .when(F.col("_v") <= 0, F.concat(F.lit("Index must be strictly positive on "), shown))
    )
    checked = rows.withColumn("_copies", copies).withColumn(
        "index_value", F.when(error.isNotNull(), F.raise_error(error).cast("double")).otherwise(F.bround("_v", 4))
    )
    return checked.select(
        "reference_date", "year", F.trim("month").alias("month_name"), "index_value", F.lit(K.CPI_FILTER["code"]).alias("item_code"),
        F.lit(K.CPI_FILTER["item"]).alias("item"), F.lit(K.CPI_BASE_YEAR).alias("base_year"), F.lit(K.CPI_FILTER["series"]).alias("series"),
        F.lit(K.CPI_FILTER["state"]).alias("state"), F.lit(K.CPI_FILTER["sector"]).alias("sector"), F.lit("MONTHLY").alias("frequency"),
    ).orderBy("reference_date")


def require_rows(series: DataFrame) -> DataFrame:
    """The same rows; an empty series is an error. Looks for one row of a monthly table."""
    if series.isEmpty():
        raise ValueError("no records matched the national airfare criteria")
    return series
