"""Small configured tables as literal rows of a plan."""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"DOUBLE('{value!r}')"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows written into the plan itself: no scan, and a known size the planner can act on.

    ``schema`` is DDL text with simple column types.
    """
    columns = [c.strip().split(" ", 1) for c in schema.split(",")]
    shown = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    names = ", ".join(name for name, _ in columns)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in columns)
        return spark.sql(f"SELECT {nulls} WHERE FALSE")
    values = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {shown} FROM VALUES {values} AS t({names})")
